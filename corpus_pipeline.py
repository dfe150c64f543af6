"""A corpus cleaned, deduplicated, decontaminated, mixed and sharded, stage by written stage.

Every stage takes all that the one before it kept, as read back from Parquet, and returns
the columns of ``documents``; the last one adds the places in the shards.  Further columns
of the table pass through whatever their names.  Null ids, repeated ids and repeated rows
are rows like others, told apart by their whole content where near duplicates go.  An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import decontaminate, jaccard, mixing, quality, sharding
from packloom.llm.shared import shared_dir


def wrapped(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and, in one struct, all others: so none can clash with what an operator adds."""
    others = [F.col(c) for c in docs.columns if c not in used]
    return docs.select(*[c for c in used if c in docs.columns], F.struct(*others).alias("_rest"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return rows.select(*[c if c in rows.columns else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with a null or empty text among them."""
    return unwrapped(quality.quality_rules(wrapped(docs, "text", "lang")).filter("kept").select("text", "lang", "_rest"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one row stays; so do all texts without words.

    It is the row of the smallest doc_id, null only where no row of the group has one, and of
    the smallest hash of the whole row among several.  Rows are told apart by that hash (64
    bits), so rows that share a doc_id but not a text are judged apart, and of equal rows one stays.
    """
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    worded = F.coalesce("text", F.lit("")).rlike("[^ \\t-\\r]")
    rows = docs.filter(worded).withColumn("_row", row)
    found = jaccard.jaccard_components(rows.select("_row", "text"), "_row", size=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    kept = found.distinct().join(ids.distinct().hint("shuffle_merge"), "_row").groupBy("component_id").agg(first).select("first._row")
    once = rows.dropDuplicates(["_row"]).join(kept.hint("shuffle_merge"), "_row", "left_semi")
    return once.select(docs.columns).unionByName(docs.filter(~worded))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat, twice at most; every document stays at least once, and so does every repeated row."""
    return unwrapped(mixing.mix(wrapped(docs, "doc_id", "text", "source"), max_repeats=2.0).select("doc_id", "text", "source", "_rest"), docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of a reproducible shuffle; counts differ by one at most.  Columns named like the three added ones are replaced."""
    return sharding.shard(docs, 16)


STAGES = [
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard_rows),
]

#: Corpus references, MinHash bands, component searches and hashed row numbers have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """All stages over ``documents``; each is written under ``work``, or else the session's checkpoint folder, and read again."""
    work = work or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{work}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
