"""The same aggregates on unbounded tables."""
