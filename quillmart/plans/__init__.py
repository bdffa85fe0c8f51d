"""Plans of the commerce engine."""
