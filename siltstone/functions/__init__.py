"""Column expressions and Python functions for artifact texts, paths, usage records and labels."""
