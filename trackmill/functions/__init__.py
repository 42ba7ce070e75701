"""Column expressions: rounding, run-id checks, grading, metric changes, JSON."""
