"""Sources of the commerce engine."""
