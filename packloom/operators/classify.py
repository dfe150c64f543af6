"""Relative paths and entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.fields import entity_type


def with_rel(paths: DataFrame) -> DataFrame:
    """Add ``rel``: the path below ``root``."""
    return paths.withColumn("rel", F.expr("substring(path, length(root) + 2)"))


def classify(docs: DataFrame) -> DataFrame:
    """Set ``entity_type`` from ``rel``; null when no type name occurs in it."""
    return docs.withColumn("entity_type", entity_type(F.col("rel")))


def type_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("entity_type").agg(F.count("*").alias("n"))
