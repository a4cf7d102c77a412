"""Spark-first engine for structure-recognition tables: curation, graph building, label matching and scoring."""
