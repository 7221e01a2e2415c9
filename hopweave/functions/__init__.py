"""Functions of the link-graph engine."""
