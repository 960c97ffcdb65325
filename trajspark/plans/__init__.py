"""plans of the GPS trajectory engine."""
