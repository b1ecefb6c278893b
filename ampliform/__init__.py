"""Amplicon-read analytics as Spark DataFrame jobs."""
