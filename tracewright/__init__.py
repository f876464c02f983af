"""Trace provenance analytics on Spark."""
