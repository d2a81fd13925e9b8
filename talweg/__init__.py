"""Mesh-field analytics on Spark DataFrames: many meshes at once, keyed by ``mesh_id``."""
