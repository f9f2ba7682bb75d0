"""Marketplace partner analytics as Spark DataFrame jobs."""
