"""Plans of the link-graph engine."""
