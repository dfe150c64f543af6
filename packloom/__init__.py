"""Packloom: content-pack checking, generation and loading as Spark DataFrame jobs."""
