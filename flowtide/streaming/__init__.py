"""streaming of the movement library."""
