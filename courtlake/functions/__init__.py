"""functions of the league engine."""
