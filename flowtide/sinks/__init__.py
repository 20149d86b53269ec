"""sinks of the movement library."""
