"""End-to-end products on top of the operators."""
