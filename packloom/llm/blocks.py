"""Corpus-wide counts of n-grams, asked and answered by blocks of documents.

Counting every n-gram as a row of its own would move far more bytes than the texts hold.
Here the documents are dealt into blocks of a few megabytes.  Each block asks for its own
distinct n-grams: packed arrays of sorted keys, cut into buckets by their leading bits.
Each bucket adds up what all blocks ask for and answers every block in its order.  A
block then reads its texts again next to its answers.  Blocks and buckets grow in number
with the corpus and never in size.

No block writes to every bucket, which would make messages grow with the square of the
corpus: it cuts its keys into at most 2 ** ``FAN`` ranges.  Where there are more buckets, as
many blocks as there are ranges hand what they ask of one range to a node of its own, which
merges it, asks on for them all (again of at most 2 ** ``FAN`` parts of the range) and hands
the answers back.  So messages grow with the corpus times the number of such hops, its
logarithm to the base 256.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.textvec import U

ASK = "bucket long, block int, n int, width int, keys binary, counts binary, apart binary"
ANSWER = "block int, bucket long, counts binary, apart binary, n_distinct long, total long"
#: Block number of the rows that sum up a bucket.
SUMMARY = -1
#: Bits of a hop.
FAN = 8


def plan_blocks(docs: DataFrame, text_col: str, block_bytes: int = 4 << 20) -> tuple[int, int]:
    """(blocks, bits of the buckets) for this table, from its bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(48, -(-total // block_bytes))
    return int(blocks), int(blocks - 1).bit_length()


def block_of(blocks: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def narrow(x: np.ndarray, width: int) -> bytes:
    if width == 32:
        return x.astype(np.uint32).tobytes()
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()


def widen(b: bytes, width: int) -> np.ndarray:
    if width == 32:
        return np.frombuffer(b, np.uint32).astype(U)
    part = np.frombuffer(b, np.uint8).reshape(-1, width // 8)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, : width // 8] = part
    return full.view("<u8").reshape(-1)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them all, told by the first byte."""
    most = int(counts.max()) if len(counts) else 0
    code = next(c for c in (1, 2, 4, 8) if most < 1 << (8 * c) or c == 8)
    return bytes([code]) + counts.astype(f"<u{code}").tobytes()


def read_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def ask_rows(block: int, keys: np.ndarray, counts: np.ndarray, bits: int, width: int, base: int = 0, apart: np.ndarray | None = None, fan: int = FAN) -> pa.Table:
    """One row per range of the next hop that the block's keys (ascending, distinct) fall into.

    ``bits`` is what is left to tell the buckets apart, ``width`` what tells keys apart in a
    bucket; ``base`` numbers the part of all buckets that is meant.  ``apart``: counts that are
    also summed on their own, over the blocks that give such.
    """
    top = min(bits, fan)
    wide = -(-(bits - top + width) // 8) * 8
    bounds = np.append(np.searchsorted(keys, np.arange(1 << top, dtype=U) << U(64 - top)), len(keys))
    short = (keys << U(top)) >> U(64 - wide)
    rows = [
        ((base << top) + i, block, int(b - a), wide, narrow(short[a:b], wide), pack_counts(counts[a:b]), None if apart is None else pack_counts(apart[a:b]))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
        if b > a
    ]
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "block", "n", "width", "keys", "counts", "apart"])


class Asked:
    """Rows of one bucket or node, their keys merged: ``keys`` (left-aligned, ascending, distinct), ``at`` (where each asked key is among them)."""

    def __init__(self, rows: pa.Table, most: int | None):
        self.blocks, self.most = rows["block"].to_pylist(), most
        asked = np.concatenate([widen(b, w) << U(64 - w) for b, w in zip(rows["keys"].to_pylist(), rows["width"].to_pylist(), strict=True)])
        self.keys, self.at = np.unique(asked, return_inverse=True)
        self.counts = self.summed([read_counts(b) for b in rows["counts"].to_pylist()])
        apart = rows["apart"].to_pylist()
        self.gives = [b is not None for b in apart]
        sizes = rows["n"].to_pylist()
        self.apart = self.summed([np.zeros(n, np.int64) if b is None else read_counts(b) for b, n in zip(apart, sizes, strict=True)]) if any(self.gives) else None
        ends = np.cumsum(sizes)
        self.spans = list(zip(ends - sizes, ends, strict=True))

    def summed(self, parts: list[np.ndarray]) -> np.ndarray:
        total = np.bincount(self.at, weights=np.concatenate(parts), minlength=len(self.keys)).astype(np.int64)
        return total if self.most is None else np.minimum(total, self.most)

    def answers(self, bucket: int, counts: np.ndarray, apart: np.ndarray | None, summary: tuple[int, int] | None = None) -> pa.Table:
        """One row per asking block, its counts in the order of its keys; ``summary``: one more row with these totals."""
        out = counts[self.at]
        own = None if apart is None else apart[self.at]
        rows = [(block, bucket, pack_counts(out[a:b]), pack_counts(own[a:b]) if gives else None, None, None) for block, gives, (a, b) in zip(self.blocks, self.gives, self.spans, strict=True)]
        if summary:
            rows.append((SUMMARY, bucket, None, None, *summary))
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "bucket", "counts", "apart", "n_distinct", "total"])


def answers(asked: DataFrame, bits: int, width: int, most: int | None = None, fan: int = FAN, finish: Callable | None = None) -> DataFrame:
    """Sums of each key's counts over all blocks, sent to every block that asked, in the order it asked.

    ``most`` stops sums there.  ``finish(keys, counts)`` gives what is answered instead of a
    bucket's sums; its keys are without their ``bits`` leading bits, left-aligned.  One more row per bucket, of block ``SUMMARY``, has its number
    of distinct keys with a count and the sum of all counts.
    """

    def add_up(rows: pa.Table) -> pa.Table:
        got = Asked(rows, most)
        if finish:
            got.counts, got.apart = (x if x is None else finish(got.keys, x) for x in (got.counts, got.apart))
        return got.answers(rows["bucket"][0].as_py(), got.counts, got.apart, (int((got.counts > 0).sum()), int(got.counts.sum())))

    if bits <= fan:
        return asked.groupBy("bucket").applyInArrow(add_up, ANSWER)
    left = bits - fan
    dealt = asked.withColumn("node", F.expr(f"block div {1 << fan}").cast("int")).groupBy("bucket", "node")

    def merge(rows: pa.Table) -> pa.Table:
        got = Asked(rows, most)
        return ask_rows(rows["node"][0].as_py(), got.keys, got.counts, left, width, rows["bucket"][0].as_py(), got.apart, fan)

    def spread(rows: pa.Table, answer: pa.Table) -> pa.Table:
        got = Asked(rows, most)
        apart = None if got.apart is None else read_answers(answer, "apart")
        return got.answers(rows["bucket"][0].as_py(), read_answers(answer), apart)

    further = answers(dealt.applyInArrow(merge, ASK), left, width, most, fan, finish)
    back = further.filter(F.col("block") != SUMMARY).withColumn("parent", F.shiftright("bucket", min(left, fan)))
    handed = dealt.cogroup(back.groupBy("parent", "block")).applyInArrow(spread, ANSWER)
    return handed.unionByName(further.filter(F.col("block") == SUMMARY))


def read_answers(rows: pa.Table, column: str = "counts") -> np.ndarray:
    """A block's answers in the order of its keys, buckets ascending."""
    pairs = sorted(zip(rows["bucket"].to_pylist(), rows[column].to_pylist(), strict=True))
    return np.concatenate([read_counts(b) for _, b in pairs]) if pairs else np.zeros(0, np.int64)


def with_answers(blocked: DataFrame, answered: DataFrame, read: Callable, schema) -> DataFrame:
    """``read(texts of a block, its answers)`` for every block."""
    answered = answered.filter(F.col("block") != SUMMARY).select("block", "bucket", "counts", "apart")
    return blocked.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(read, schema)
