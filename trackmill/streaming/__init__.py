"""Structured Streaming versions of the incremental folds."""
