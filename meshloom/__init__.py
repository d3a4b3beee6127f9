"""Mesh and graph partitioning analytics on Spark."""
