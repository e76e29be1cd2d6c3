"""Streaming of the propagation engine."""
