"""Compositions: the end-to-end outputs, and the queries over the driver tables."""
