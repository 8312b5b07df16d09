"""operators of tandemlab."""
