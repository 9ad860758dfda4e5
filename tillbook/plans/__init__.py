"""The registered queries: operators with their parameters, and the same in plain SQL."""
