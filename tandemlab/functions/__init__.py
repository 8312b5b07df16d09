"""functions of tandemlab."""
