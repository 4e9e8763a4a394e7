"""Relational, graph, resolution, extraction and rendering operators over the five tables of an index."""
