"""Training-data operators. Nothing outside this subpackage imports it; ``registry`` lists its queries."""
