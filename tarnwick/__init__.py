"""Catalogue ingestion, matching, graph and corpus operators on PySpark DataFrames."""
