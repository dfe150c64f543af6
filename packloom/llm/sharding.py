"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in a fixed order (bucket of a hash, then the key, then the
text's checksum); the number is permuted and dealt out: shard = p mod shards,
slot = p div shards.  So shard sizes differ by one at most, slots have no gaps, and the
place of a row follows from its number alone.

Null keys and null texts are numbered like others; texts of any length only count by their
checksum.  Rows equal in key and text may exchange their places.  An empty table gives no
rows.  Input columns named like an added one (row_no, shard, slot) are replaced.  ``rows``
is the law that holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.shared import cut

#: Round constants, all below 2**31.
ROUNDS = [(1103515245, 12345), (1664525, 1013904223), (214013, 2531011), (1140671485, 12820163), (69069, 362437), (1597334677, 907633385)]
PRIME = 2147483647


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds n numbers."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 at x; numbers that leave the range walk on until they are back."""
    bits = half_bits(n)
    low = (1 << bits) - 1

    def once(v):
        left, right = v >> bits, v & low
        for a, b in reversed(ROUNDS) if inverse else ROUNDS:
            key = left if inverse else right
            f = (key * a + b + seed) % PRIME
            f = ((f ^ (f >> 15)) * 48271) % PRIME & low
            left, right = (right ^ f, left) if inverse else (right, left ^ f)
        return (left << bits) | right

    x = once(np.asarray(x, np.int64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x


def bucket_starts(counts: DataFrame, width: int = 1024) -> DataFrame:
    """``counts`` (bucket, n) with ``start``, the number of rows in all buckets before.

    Running sums within every ``width`` buckets, and over the sums of those: no step sees
    more than a ``width``-th of the buckets in one task.
    """
    part = F.expr(f"bucket div {width}")
    inner = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parted = counts.withColumn("part", part)
    parts = parted.groupBy("part").agg(F.sum("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(outer), F.lit(0)))
    within = parted.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(parts.hint("shuffle_merge"), "part").select("bucket", (F.col("before") + F.col("inside")).alias("start"))


def number_rows(docs: DataFrame, key: Column, tie: Column, rows_per_bucket: int = 20_000) -> tuple[DataFrame, int]:
    """Add ``row_no``, dense from 0 in the order of (hash bucket, key, tie); also the number of rows.

    Counts of buckets stay in Spark and are joined to the rows, which are dealt out by
    bucket anyway.  Rows equal in key and tie fall into one bucket, where any part of them
    may be in any order.
    """
    keyed = docs.withColumns({"_key": key, "_tie": tie})
    total = docs.count()
    buckets = max(64, total // rows_per_bucket)
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_tie"), F.lit(buckets)))
    counts = keyed.groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"))
    starts = cut(bucket_starts(counts))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "_tie"))
    placed = keyed.join(starts.hint("shuffle_merge"), F.col("_bucket") == F.col("bucket"))
    return placed.withColumn("row_no", F.col("start") + within - 1).drop("_key", "_tie", "_bucket", "bucket", "start"), total


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text_col: str = "text", seed: int = 0, tie: Column | None = None) -> DataFrame:
    """Add ``row_no``, ``shard`` and ``slot`` to every row; columns of these names are replaced."""
    docs = docs.drop("row_no", "shard", "slot")
    tie = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) if tie is None else tie
    numbered, n = number_rows(docs, F.col(key), tie)

    @F.pandas_udf("long")
    def place(no: pd.Series) -> pd.Series:
        return pd.Series(permute(no.to_numpy(), n, seed))

    return (
        numbered.withColumn("_place", place("row_no"))
        .withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )
