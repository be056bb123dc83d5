"""Column functions: each takes and returns Columns, adds no shuffle."""
