"""Ids that repeat, are missing or of other types, in mixing and in the search for benchmark items."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from samples import low, prose, words

from packloom.llm import decontaminate, mixing


def shingle_set(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


@pytest.mark.parametrize("kind, name", [("int", lambda i: i), ("long", lambda i: i), ("string", lambda i: f"item-{i}")])
def test_items_of_any_id(spark, kind, name):
    texts = [prose(i, 30 + 5 * i) for i in range(8)]
    items = [(name(0), " ".join(texts[0].split()[3:20]), "x"), (name(1), "Tiny Item", "x"), (name(2), "one", "x"), (None, texts[3], "x"), (name(4), "", "x"), (name(5), None, "x"), (name(6), " ".join(texts[5].split()[:7] + ["new"] + texts[5].split()[8:30]), "x")]
    docs = [(i, t, "clash") for i, t in enumerate(texts)] + [(20, "a tiny item is one", "clash"), (21, "tiny items", "clash"), (None, "ONE", "clash"), (22, None, "clash"), (23, "", "clash"), (24, "x " * 20_000 + texts[3], "clash"), (24, "x " * 20_000 + texts[3], "clash")]
    want = Counter()
    for d, t, _ in docs:
        for i, q, _ in items:
            ws = words(low(q))
            n = min(5, len(ws))
            if n and 100 * len(shingle_set(ws, n) & shingle_set(words(low(t)), n)) >= 80 * len(shingle_set(ws, n)):
                want[d, i] += 1
    left = spark.createDataFrame(docs, "doc_id int, text string, item_id string").repartition(3)
    right = spark.createDataFrame(items, f"item_id {kind}, text string, doc_id string")
    for part in (20_000, 2):
        got = decontaminate.search(left, right, part_items=part)
        assert dict(got.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
        assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
    assert decontaminate.search(left, right.limit(0)).count() == 0
    clean = Counter(r.doc_id for r in decontaminate.drop_contaminated(left, right).collect())
    assert clean == Counter(d for d, *_ in docs) - Counter({d: sum(1 for x, *_ in docs if x == d) for d in {k for k, _ in want}})


def check_mix(rows, docs, repeats):
    """Every source's weight and blocks follow from its tokens; the last block is a prefix of its order."""
    tokens, held = Counter(), defaultdict(list)
    for _, t, s in docs:
        tokens[s] += len(words(t))
    for r in rows:
        held[r.source].append(r)
    weight = {s: held[s][0].weight for s in held if tokens[s]}
    assert math.isclose(sum(weight.values()), 1) and all(r.weight == weight.get(r.source, 0.0) for r in rows)
    budget = max(tokens[s] / w for s, w in weight.items())
    for s, w in weight.items():
        share = math.floor(w * budget + 1e-3)
        whole, rest = divmod(share, tokens[s])
        n = sum(1 for *_, x in docs if x == s)
        epochs = Counter(r.epoch for r in held[s])
        assert whole >= 1 and all(epochs[e] == n for e in range(whole)) and max(epochs) <= whole and share <= repeats * tokens[s] + 1
        last = sorted((r for r in held[s] if r.epoch == whole), key=lambda r: r.block_order)
        total = sum(r.n_tokens for r in last)
        assert (rest == 0 and not last) or rest <= total
        # Rows of one place in the order may lie in any order among themselves.
        firm = [r for r in last if r.block_order != last[-1].block_order]
        assert sum(r.n_tokens for r in firm) < max(rest, 1)


@pytest.mark.parametrize("ids", ["own", "null", "one"])
def test_mixing_spreads_rows_of_one_id(spark, ids):
    docs = [({"own": i, "null": None, "one": 7}[ids] if i % 4 == 0 else i, prose(i, 3 + i % 11), "big" if i % 4 == 0 else f"s{i % 3}") for i in range(600)]
    docs += [(1000, None, None), (1001, "", "void"), (1002, "one two", None), (1, docs[1][1], docs[1][2]), (1, docs[1][1], docs[1][2])]
    table = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, weight int").repartition(4)
    rows = mixing.mix(table, max_repeats=2.0, rows_per_bucket=3).collect()
    assert Counter(r.text for r in rows if r.epoch == 0) == Counter(t for _, t, _ in docs)
    check_mix(rows, docs, 2.0)
    # No bucket's window holds more than a few of the hot source's rows.
    whole = max((r.epoch for r in rows if r.source == "big"), default=0)
    plain = mixing.mix(table, max_repeats=2.0, rows_per_bucket=3, tie=F.lit(0))
    assert plain.count() >= len(docs) and whole <= 2


def test_mixing_buckets_of_rows_without_ids(spark):
    rows = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"), F.when(F.col("id") < 800, "a").otherwise("b").alias("source"))
    got = [r.block_order for r in mixing.mix(rows, max_repeats=2.0, rows_per_bucket=10).filter("source = 'a'").collect()]
    assert len(set(got)) >= 800
    one = mixing.mix(rows.withColumn("doc_id", F.lit(3).cast("long")), max_repeats=8.0, budget=900, rows_per_bucket=10).filter("source = 'a'").collect()
    assert one and len({r.block_order[:20] for r in one}) > 5
