"""Inputs: tables, versioned logs of input cells, keyed tables."""
