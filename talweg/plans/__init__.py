"""Plans of the mesh-field engine."""
