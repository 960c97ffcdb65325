"""functions of the GPS trajectory engine."""
