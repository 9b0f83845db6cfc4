"""plans of the blockloom engine."""
