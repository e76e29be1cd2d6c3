"""Sources of the propagation engine."""
