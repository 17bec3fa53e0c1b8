"""plans of the league engine."""
