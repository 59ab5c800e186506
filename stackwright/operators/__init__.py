"""DataFrame operators of the catalog engine."""
