"""Functions of the mesh-field engine."""
