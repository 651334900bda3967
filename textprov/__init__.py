"""Text-provenance analytics on PySpark."""
