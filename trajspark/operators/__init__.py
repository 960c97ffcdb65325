"""operators of the GPS trajectory engine."""
