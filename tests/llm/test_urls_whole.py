"""The URL models learn from all labelled URLs, in whole, whatever the number of hops between blocks."""

import zlib

import numpy as np
import pytest

from test_models import plain_model

from packloom.llm import urls

RULES = [("com/", "allow"), ("net/", "block")]


def learned(url):
    return zlib.crc32(url.encode()) % 5 != 0


def test_scores_are_those_of_models_of_all_labelled_urls(spark):
    """5,000 and 4,500 learnable URLs and one that tells its class by its end only, after 2,500 characters."""
    good = [u for u in (f"a://x.com/{i}" for i in range(7000)) if learned(u)][:5000]
    bad = [u for u in (f"b://y.net/{i * 7}" for i in range(7000)) if learned(u)][:4500]
    held = [u for u in [f"a://x.com/{i}" for i in range(200)] + [f"b://y.net/{i * 7}" for i in range(200)] if not learned(u)]
    long = next(u for u in (f"c://z.com/{'k' * 2500}{i}/qqqzzz" for i in range(9)) if learned(u))
    asked = ["d://w.org/qqqzzz", "d://w.org/4999", "b://w.org/é", "x" * 3000, ""]
    rows = [*good, *bad, *held, long, *asked, *asked, None]
    got = urls.filter_urls(spark.createDataFrame([(u, 1) for u in rows], "url string, score int"), RULES, order=3).collect()
    assert len(got) == len(rows)
    a, r = plain_model([*good, long], 3), plain_model(bad, 3)
    for row in got:
        if row.url not in asked and row.url not in (long, None) and row.url not in held[:50]:
            continue
        assert row.score == pytest.approx(a(row.url) - r(row.url) if row.url else 0.0, abs=1e-9)
    ask = {u: row for u in asked for row in got if row.url == u}
    assert ask["d://w.org/qqqzzz"].verdict == "allow" and {row.verdict for row in got if row.rule == "net/"} == {"block"}


def test_hops_and_pieces_change_no_score(spark, monkeypatch):
    rows = [(f"a://x{i % 7}.com/{i}", "allow") for i in range(60)] + [(f"b://y{i % 5}.net/{i * 7}", "block") for i in range(60)] + [("c://" + "open" * 50, None), ("", None), ("\U0001f600é", None)]
    judged = spark.createDataFrame(rows, "url string, verdict string")
    once = {r.url: r.score for r in urls.scored_urls(judged).collect()}
    hops = {r.url: r.score for r in urls.scored_urls(judged.union(judged), fan=2).collect()}
    assert once.keys() == hops.keys() == {u for u, _ in rows} and all(once[u] == pytest.approx(hops[u], abs=1e-12) for u in once)
    label = np.array([1, -1, 1, 0])
    texts = ["a://x.com/123123", "b://y.net/" + "9" * 40, "a://x.com/7", "z"]
    whole = urls.block_counts(texts, label, 3)
    monkeypatch.setattr(urls, "PIECE", 7)
    assert all((x == y).all() for x, y in zip(whole, urls.block_counts(texts, label, 3), strict=True))


def test_the_threshold_is_the_best_on_held_out_urls(spark):
    def cut(scores):
        return urls.threshold_of(spark.createDataFrame([("u", k, s) for k, s in scores], "url string, label int, score double"))

    assert cut([(2, 0.5), (2, 0.25), (-2, -0.5), (1, -9.0), (0, -7.0)]) == 0.0
    assert cut([(2, 0.5), (2, 0.75), (-2, 0.25), (-2, -0.5)]) == pytest.approx(0.25 + 1 / 1024)
    assert cut([(2, 0.5), (1, 0.1)]) == 0.0 and cut([]) == 0.0


def test_without_one_class_all_is_allowed(spark):
    got = urls.filter_urls(spark.createDataFrame([(f"b://y.net/{i}",) for i in range(20)] + [("q://w.org",)], "url string"), RULES).collect()
    assert {r.score for r in got} == {0.0} and [r.verdict for r in got if r.rule is None] == ["allow"]
