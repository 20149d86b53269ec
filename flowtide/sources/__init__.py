"""sources of the movement library."""
