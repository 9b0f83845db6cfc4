"""operators of the blockloom engine."""
