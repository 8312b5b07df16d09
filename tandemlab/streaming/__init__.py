"""streaming of tandemlab."""
