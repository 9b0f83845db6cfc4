"""streaming of the blockloom engine."""
