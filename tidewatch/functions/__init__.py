"""Column functions: each takes and returns columns, so that Catalyst sees plain expressions."""
