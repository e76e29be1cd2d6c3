"""Plans of the propagation engine."""
