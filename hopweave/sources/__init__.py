"""Sources of the link-graph engine."""
