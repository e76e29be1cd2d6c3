"""Functions of the propagation engine."""
