"""Operators of the propagation engine."""
