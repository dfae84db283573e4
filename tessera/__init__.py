"""Spark jobs for a searchable knowledge corpus."""
