"""streaming of the league engine."""
