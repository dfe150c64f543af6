"""Edges of the other operators: very long texts, empty tables, missing ids and columns of clashing names."""

import hashlib
import math

import pytest
from samples import prose

from packloom.llm import chat, licenses, lm, quality, sharding


def test_a_very_long_text_has_its_license_at_the_end(spark):
    long = "word " * 100_000
    rows = [(1, long + "under the MIT License", 5, "x"), (1, long + "under the MIT License", 5, "x"), (2, long, 5, "x")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, n_words int, base_labels string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels) for r in got) == [(1, 100_004, 1, 100_002, "mit")] * 2 + [(2, 100_000, 0, None, "")]


def test_talks_without_end_and_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string, example string, is_last int"
    assert chat.digests(chat.examples(spark.createDataFrame([], schema))).count() == 0
    texts = [("user" if t % 2 == 0 else "assistant", f"turn {t} <turn user> ~" + "é" * (20_000 if t == 7 else 3)) for t in range(120)]
    rows = [(5, t, role, text, "clash", 1) for t, (role, text) in enumerate(texts)]
    got = chat.digests(chat.examples(spark.createDataFrame(rows, schema).repartition(4))).collect()
    loss = "".join(text for role, text in texts if role == "assistant")
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in got] == [(120, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), 60)]


def test_scores_of_rows_without_ids(spark):
    rows = [(i, prose(i % 9, 30)) for i in range(40)] + [(None, prose(1, 30)), (None, None), (None, ""), (3, "x" * 200_000)]
    got = lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_known int")).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in got)
    none = sorted((r.n_tokens for r in got if r.doc_id is None))
    assert none == [1, 1, 31]


@pytest.mark.parametrize("text", ["word " * 80_000, "#" * 300_000, "\n" * 100_000, "\n".join(["same line here"] * 20_000)])
def test_very_long_documents_have_counts(spark, text):
    got = quality.quality_rules(spark.createDataFrame([(1, text, "en", True), (2, None, None, None)], "doc_id long, text string, lang string, kept boolean")).orderBy("doc_id").collect()
    assert got[0].n_words == len(text.split()) and got[1].n_words == 0 and not got[1].kept
    assert sorted(r.slot for r in sharding.shard(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string"), 1).collect()) == [0, 1, 2]
