"""End-to-end flows over the operators."""
