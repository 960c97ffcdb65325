"""sources of the GPS trajectory engine."""
