"""plans of tandemlab."""
