"""streaming of the GPS trajectory engine."""
