"""Operators for large-scale training-data pipelines (kept apart from the terrain library)."""
