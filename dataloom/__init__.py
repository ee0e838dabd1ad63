"""Profiling, validating, preparing and versioning datasets as Spark jobs."""
