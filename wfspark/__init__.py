"""Workforce and people analytics as Spark DataFrame transforms."""
