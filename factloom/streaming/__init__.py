"""The same expressions over unbounded tables."""
