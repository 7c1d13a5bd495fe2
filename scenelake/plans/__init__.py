"""Composed plans: the scene graph, its stages, and the query catalogue."""
