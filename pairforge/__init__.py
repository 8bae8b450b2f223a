"""Paired-comparison analytics on Spark."""
