"""Reports and ledger rules: every operator takes tables and returns a DataFrame."""
