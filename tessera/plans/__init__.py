"""Whole workloads, and their queries over the example tables."""
