"""Passes as micro-batches, and operators that keep state between them."""
