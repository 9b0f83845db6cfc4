"""functions of the blockloom engine."""
