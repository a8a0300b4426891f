"""DataFrame operators: one module an analysis."""
