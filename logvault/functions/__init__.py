"""Column-level helpers: path syntax, variant access, token analysis."""
