"""functions of the movement library."""
