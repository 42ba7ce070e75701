"""DataFrame -> DataFrame operators, each keyed by run."""
