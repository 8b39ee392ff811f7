"""Annotation of citation corpora on Spark."""
