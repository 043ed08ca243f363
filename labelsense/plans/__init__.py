"""Spark ML stages, pipelines, training, scoring."""
