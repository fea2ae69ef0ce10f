"""Lodestone: Spark jobs that turn document collections into a searchable, governed knowledge graph."""
