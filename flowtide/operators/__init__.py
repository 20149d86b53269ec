"""operators of the movement library."""
