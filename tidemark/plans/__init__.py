"""End-to-end products composed from the operators."""
