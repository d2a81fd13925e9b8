"""Operators of the mesh-field engine."""
