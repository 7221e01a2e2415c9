"""Operators of the link-graph engine."""
