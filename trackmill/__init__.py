"""trackmill: object-tracking analytics as PySpark DataFrame operators."""
