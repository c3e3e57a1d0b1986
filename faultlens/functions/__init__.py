"""Column expressions: no function here starts a job or adds a shuffle."""
