"""Column expressions: time grid, casts, flags, array arithmetic, losses."""
