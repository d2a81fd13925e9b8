"""Sources of the mesh-field engine."""
