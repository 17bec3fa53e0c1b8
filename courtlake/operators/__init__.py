"""operators of the league engine."""
