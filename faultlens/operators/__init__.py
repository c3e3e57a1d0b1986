"""DataFrame operators, one module per group."""
