"""sources of the league engine."""
