"""sources of tandemlab."""
