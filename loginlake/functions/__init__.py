"""Column expressions and driver-side argument checks."""
