"""Operators over cells, keyed tables, change sets and arrays."""
