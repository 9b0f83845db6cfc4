"""sources of the blockloom engine."""
