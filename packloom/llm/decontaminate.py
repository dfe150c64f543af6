"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size.  A partition cuts each document, whatever its length,
into blocks of its largest item's number of shingles, and takes the MinHash of every two
neighbouring blocks, so that a short item is compared with windows of about its own size.
A window whose minimum under some hash is an item's minimum makes the document a
candidate for that item; each hash is a band of one row.  Candidates are verified by exact
containment of the item's distinct shingles in the whole document.

An item at the containment threshold within one window misses all bands with a chance of
about (1 - threshold / (2 * ratio + 1 - threshold)) ** hashes, below 1 in 500 here; a
whole copy with less than 1 in 10,000.

Shingles are ``size`` words with A-Z in lower case; an item with fewer words is one
shingle of all its words, looked for among windows of that length.  Items without words
match nothing, as do null and empty documents.  A document of any length is searched whole
in its task.  Repeated items and documents each match on their own.  Null ids are ids like
others, and ids may be of any type.  An empty table on either side gives no matches, and then all documents are clean.
Columns other than id and text are left out of matches; clean documents keep all theirs.
The items are sent to the tasks in parts of about ``part_items`` items and ``PART_BYTES``, one search of
the documents each, so what is broadcast stays bounded however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from packloom.llm import textvec as V
from packloom.llm.textvec import U


@dataclass
class SizePart:
    """Items of one shingle length and size class: the class's block length and, per hash, the items by their minima."""

    length: int
    block: int
    items: list[int]
    minima: list[tuple[np.ndarray, np.ndarray]]


@dataclass
class ItemIndex:
    ids: list
    sets: list[np.ndarray]
    parts: list[SizePart]
    hashes: int

    @classmethod
    def build(cls, ids: list, texts: list[str], size: int, ratio: float, hashes: int) -> ItemIndex:
        w = V.words(*V.raw(pa.array(texts, pa.large_string())))
        sets, lengths, spans = [], [], []
        for i in range(len(ids)):
            own = V.Words(w.hash[w.first[i] : w.first[i + 1]], np.zeros(w.counts[i], np.int64), np.array([0, w.counts[i]]), w.inside, w.start, w.end)
            length = int(min(size, w.counts[i]))
            values = V.shingles(own, length, short=False)[0] if length else np.zeros(0, U)
            sets.append(np.unique(values))
            lengths.append(length)
            spans.append(len(values))
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (length, n) in enumerate(zip(lengths, spans, strict=True)):
            if n:
                groups.setdefault((length, int(np.floor(np.log(n) / np.log(ratio) + 1e-9))), []).append(i)
        parts = []
        for (length, _), items in sorted(groups.items()):
            minima = []
            for h in range(hashes):
                mins = np.array([hashed(sets[i], h).min() for i in items], U)
                order = np.argsort(mins, kind="stable")
                minima.append((mins[order], np.array(items)[order]))
            parts.append(SizePart(length, max(spans[i] for i in items), items, minima))
        return cls(ids, sets, parts, hashes)


def hashed(shingle: np.ndarray, h: int) -> np.ndarray:
    return (shingle ^ V.ODD[h]) * V.ODD[(h * 7 + 13) % 64]


def candidates(index: ItemIndex, values: np.ndarray, bounds: np.ndarray, parts: list[SizePart]) -> set[tuple[int, int]]:
    """(text, item) pairs of a chunk; ``values``: shingles of one length in order, ``bounds``: where each text's begin."""
    found: set[tuple[int, int]] = set()
    counts = np.diff(bounds)
    texts = np.flatnonzero(counts)
    layout = []
    for part in parts:
        n = -(-counts[texts] // part.block)
        first = np.cumsum(n) - n
        owner = np.repeat(texts, n)
        begin = np.repeat(bounds[:-1][texts], n) + (np.arange(len(owner)) - np.repeat(first, n)) * part.block
        layout.append((part, begin, owner))
    if not len(texts):
        return found
    for h in range(index.hashes):
        mixed = hashed(values, h)
        for part, begin, owner in layout:
            low = np.minimum.reduceat(mixed, begin)
            pair = np.minimum(low[:-1], low[1:])
            inner = owner[:-1] == owner[1:]
            low[:-1] = np.where(inner, pair, low[:-1])
            # The last block of a longer text is covered by the window before it, and by itself.
            keys, items = part.minima[h]
            lo = np.searchsorted(keys, low, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == low)
            for k in hit:
                for j in range(lo[k], len(keys)):
                    if keys[j] != low[k]:
                        break
                    found.add((int(owner[k]), int(items[j])))
    return found


def search_texts(index: ItemIndex, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shared shingles, item's shingles) of every verified pair."""
    by_length: dict[int, list[SizePart]] = {}
    for part in index.parts:
        by_length.setdefault(part.length, []).append(part)
    for a, b in V.slices(texts):
        w = V.words(*V.raw(texts.slice(a, b - a)))
        for length, parts in by_length.items():
            values, owner = V.shingles(w, length, short=False)
            bounds = np.searchsorted(owner, np.arange(b - a + 1))
            of_text: dict[int, list[int]] = {}
            for text, item in candidates(index, values, bounds, parts):
                of_text.setdefault(text, []).append(item)
            for text, items in of_text.items():
                own = np.unique(values[bounds[text] : bounds[text + 1]])
                for item in items:
                    wanted = index.sets[item]
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    shared = int((own[at] == wanted).sum())
                    if 100 * shared >= percent * len(wanted):
                        yield a + text, item, shared, len(wanted)


#: Bytes of item texts in one part, about.
PART_BYTES = 32 << 20


def item_parts(items: DataFrame, id_col: str, text_col: str, size: int, ratio: float, hashes: int, part_items: int) -> Iterator[ItemIndex]:
    """The items in parts of about ``part_items`` and ``PART_BYTES`` each, one part on the driver at a time."""
    dealt = items.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows, held = dealt.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-rows // part_items), -(-held // PART_BYTES))
    for k in range(n):
        rows = dealt.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield ItemIndex.build([r.id for r in rows], [r.text for r in rows], size, ratio, hashes)


def search(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", size=5, percent=80, ratio=1.5, hashes=28, part_items=20_000
) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    schema = S.StructType(
        [
            S.StructField("doc_id", docs.schema[id_col].dataType),
            S.StructField("item_id", items.schema[item_id].dataType),
            S.StructField("n_shared", S.LongType()),
            S.StructField("n_item", S.LongType()),
            S.StructField("containment", S.DoubleType()),
        ]
    )
    narrow, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    item_type = to_arrow_type(items.schema[item_id].dataType)
    for index in item_parts(items, item_id, item_text, size, ratio, hashes, part_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows = list(search_texts(index, texts, percent))
                pair, item, n_shared, n_item = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(pair, pa.int64())),
                        pa.array([index.ids[i] for i in item], item_type),
                        pa.array(n_shared, pa.int64()),
                        pa.array(n_item, pa.int64()),
                        pa.array([x / y for x, y in zip(n_shared, n_item, strict=True)], pa.float64()),
                    ],
                    names=schema.names,
                )

        found = narrow.mapInArrow(look, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col="text", item_id="item_id", item_text="text", size=5, percent=80, ratio=1.5, hashes=28, part_items=20_000) -> DataFrame:
    """The documents, all columns as they are, in which no item is found."""
    for index in item_parts(items, item_id, item_text, size, ratio, hashes, part_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in search_texts(shared.value, batch.column(batch.schema.get_field_index(text_col)), percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


ORACLE = r"""with d as (select doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
 b as (select item_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from benchmark),
 c as (select id, ws, least(5, len(ws)) l from b where len(ws) > 0), ls as (select distinct l from c),
 bs as (select distinct id, l, array_to_string(ws[i : i + l - 1], ' ') s from c, unnest(range(1, len(ws) - l + 2)) u(i)),
 ds as (select distinct id, l, array_to_string(ws[i : i + l - 1], ' ') s from d, ls, unnest(range(1, greatest(1, len(ws) - l + 2))) u(i)),
 n as (select id, count(*) n_item from bs group by 1)
 select ds.id doc_id, bs.id item_id, count(*)::bigint n_shared, any_value(n_item)::bigint n_item, count(*) / any_value(n_item)::double containment
 from ds join bs using (l, s) join n on n.id = bs.id group by 1, 2 having 100 * count(*) >= 80 * any_value(n_item)"""
