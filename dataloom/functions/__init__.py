"""Column-level helpers: column classes, missing values, parsing, rounding."""
