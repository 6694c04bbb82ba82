"""Corpus curation, retrieval and evaluation as Spark DataFrame programs."""
