"""Spark-first analytics over research text: evidence, bibliography, layout, usage."""
