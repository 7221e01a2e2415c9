"""Streaming of the link-graph engine."""
