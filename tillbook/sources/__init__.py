"""Where the tables come from and where derived ledgers go."""
