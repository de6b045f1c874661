"""Scans: edge lists, node lists, mappings, and the graphs that lie in order lines."""
