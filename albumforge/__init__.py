"""Curating large photo collections, and measuring how people curate them, on Spark."""
