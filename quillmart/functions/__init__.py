"""Functions of the commerce engine."""
