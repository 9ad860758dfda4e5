"""Column expressions and the few distributed building blocks the operators share."""
