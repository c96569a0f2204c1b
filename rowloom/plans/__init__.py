"""Composition of steps from a JSON description."""
