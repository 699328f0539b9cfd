"""Formulation and experiment analytics as Spark DataFrame jobs."""
