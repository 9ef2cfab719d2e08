"""Complete answers composed from the operators."""
