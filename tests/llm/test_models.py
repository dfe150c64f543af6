"""The models' own scores and verdicts against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from samples import ROWS, TEXTS, WORDS, low, prose, words

from packloom.llm import lm, quality, queries, sharding, urls


def test_interpolated_scores(spark, monkeypatch):
    """Bigram, unigram and uniform estimates of all training documents, mixed by the weights that EM found."""
    kept, plain = {}, lm.em
    monkeypatch.setattr(lm, "em", lambda bins: kept.setdefault("w", plain(bins)))
    rows = [(i, t) for i, t, *_ in ROWS] + [(100 + i, prose(i % 7, 25)) for i in range(60)] + [(100, prose(0, 25))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(4)
    got = Counter((r.doc_id, round(r.score, 6)) for r in lm.score(docs).collect())
    token, pair, start = Counter(), Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            ws = [*words(low(t)), None]
            token.update(ws)
            pair.update(zip(["<s>", *ws], ws))
            start += 1
    n, kinds, want = sum(token.values()), len(token), Counter()
    for i, t in rows:
        ws, total = [*words(low(t)), None], 0.0
        for a, b in zip(["<s>", *ws], ws):
            c = start if a == "<s>" else token[a]
            w2, w1, w0 = kept["w"][0 if c == 0 else int(math.log2(c)) + 1]
            total += math.log10(w2 * pair[a, b] / max(c, 1) + w1 * token[b] / n + w0 / (kinds + 1))
        want[i, round(total, 6)] += 1
    assert got == want


def test_em_climbs_to_the_weights_of_the_tokens_themselves():
    """EM over binned ratios against EM over the single tokens."""
    rng = np.random.default_rng(2)
    two = 2.0 ** rng.integers(-3, 9, 500)
    two[rng.random(500) < 0.4] = 0
    one = 2.0 ** rng.integers(-2, 4, 500)
    p = np.stack([two, one, np.ones(500)], 1)
    w = np.array([0.4, 0.4, 0.2])
    for _ in range(60):
        share = w * p / (w * p).sum(1, keepdims=True)
        w = share.mean(0)
    bins = Counter((lm.FLOOR if a == 0 else round(math.log2(a) * lm.STEPS), round(math.log2(b) * lm.STEPS)) for a, b in zip(two, one))
    found = lm.em([(4, a, b, n) for (a, b), n in bins.items()])[4]
    assert found == pytest.approx(tuple(w), abs=1e-6)


def plain_model(texts, order):
    """Witten-Bell estimates from dictionaries."""
    seen = defaultdict(Counter)
    for t in texts:
        s = "\x02" * order + t + "\x03"
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[s[i - k : i]][s[i]] += 1

    def log_prob(t):
        s, total = "\x02" * order + t + "\x03", 0.0
        for i in range(order, len(s)):
            p = 1 / 256
            for k in range(order + 1):
                after = seen.get(s[i - k : i])
                if after:
                    p = (after[s[i]] + len(after) * p) / (sum(after.values()) + len(after))
            total += math.log(p)
        return total / (len(t) + 1)

    return log_prob


def test_url_verdicts(spark):
    good = [f"https://{w}{i}.org/news/{w}" for i, w in enumerate(WORDS * 3)]
    bad = [f"http://cheap-{w}-pills{i}.biz/win?{i}" for i, w in enumerate(WORDS * 3)]
    model = urls.fit_urls(good, bad, order=3)
    a = plain_model([u for i, u in enumerate(good) if i % 5], 3)
    r = plain_model([u for i, u in enumerate(bad) if i % 5], 3)
    asked = [*good[::4], *bad[::4], "https://new.org/é", "x" * 5000, ""]
    rows = [(i, u, 5) for i, u in enumerate(asked)] + [(None, None, 5), (0, asked[0], 5)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, score int"), [], model=model).collect()
    for row in got:
        want = a(row.url) - r(row.url) if row.url else 0.0
        assert row.score == pytest.approx(want, abs=1e-9) and row.verdict == ("allow" if want >= model.threshold else "block") and row.rule is None
    assert len(got) == len(rows)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), [("com/", "allow")]).count() == 0


def test_a_hot_url_moves_no_verdict(spark):
    good = [f"https://{w}{i}.com/news" for i, w in enumerate(WORDS * 2)]
    bad = [f"http://bet-{w}-{i}.net/win" for i, w in enumerate(WORDS * 2)]
    asked = ["http://bet-river-casino.biz/win", "https://stones77.org/news"]
    rules = [("com/", "allow"), ("net/", "block")]

    def verdicts(urls_):
        got = urls.filter_urls(spark.createDataFrame([(u,) for u in urls_], "url string"), rules).collect()
        return {r.url: (r.verdict, round(r.score, 9)) for r in got}

    once = verdicts([*good, *bad, *asked])
    hot = verdicts([*good, *bad, *asked, *[bad[3]] * 3000])
    assert once == hot and once[asked[0]][0] == "block" and once[asked[1]][0] == "allow"


def divergence(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def histogram(t):
    kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t-\r]", r"[.,;:!?'\"()-]", None, r"[^\x00-\x7f]"]
    n = [0 if k is None else len(re.findall(k, t)) for k in kinds]
    n[5] = len(t) - sum(n)
    return n


def test_quality_verdicts(spark):
    """Distances and verdicts from references summed in plain Python."""
    rng = np.random.default_rng(3)
    talk = lambda k, n: " ".join(rng.choice([*quality.COMMON["en"], *WORDS]) + ("." if i % 9 == 8 else "") for i in range(n))
    rows = [(k, talk(k, 60 + 9 * k), "en") for k in range(20)] + [(50, "WIN!! $$$ NOW 4U ### " * 3 + " ".join(f"{x}$%" for x in range(200)), "en"), (51, talk(9, 90).upper(), "en"), (56, "le chat dort " + prose(8, 60), "en"), (52, talk(1, 90), None), (53, None, "en"), (54, "", "xx"), (55, "zq " + prose(4, 400).replace("e", "9"), "en")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, kept string")).collect()}
    common = {w: i for i, w in enumerate(quality.COMMON["en"])} | {w.capitalize(): i for i, w in enumerate(quality.COMMON["en"])}
    by_word = lambda t: [sum(common.get(w) == i for w in words(t)) for i in range(len(quality.COMMON["en"]))] + [sum(w not in common for w in words(t))]
    plain = lambda r: not r.base_failed and 50 * r.n_symbols <= r.word_chars
    refs = {}
    for i, t, lang in rows:
        h = histogram(t or "")
        if plain(got[i]) and 10 * h[1] <= got[i].word_chars:
            for name in {lang if lang == "en" else "other", "other"}:
                refs[name] = np.array(refs.get(name, 0)) + h
            if lang == "en":
                refs["words"] = np.array(refs.get("words", 0)) + by_word(t)
    for i, t, lang in rows:
        r = got[i]
        char = divergence(histogram(t), refs["en" if lang == "en" else "other"]) if t else 1.0
        word = (divergence(by_word(t), refs["words"]) if words(t) else 1.0) if lang == "en" else 0.0
        assert r.char_distance == pytest.approx(char, abs=1e-9) and r.word_distance == pytest.approx(word, abs=1e-9)
        assert r.kept == (not r.base_failed and (r.word_chars < 200 or char <= 0.3) and (r.n_words < 80 or char + word <= 0.44))
    assert not got[50].kept and not got[51].kept and not got[53].kept and got[3].kept and got[52].kept


def test_shard_query(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in ROWS] + [(None, "x"), (4, None), (0, TEXTS[0])]
    spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, slot int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_feistel_shards(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted((r.slot, r.shard) for r in got) == [(k // 16, k % 16) for k in range(len(rows))]
    place = sharding.permute(np.array([r.row_no for r in got]), len(rows))
    assert all(p == r.slot * 16 + r.shard for p, r in zip(place, got, strict=True))


def test_bucket_starts(spark):
    counts = spark.createDataFrame([(b, b % 5 + 1) for b in range(40) if b % 7], "bucket long, n long")
    got = {r.bucket: r.start for r in sharding.bucket_starts(counts, width=8).collect()}
    total = 0
    for b in range(40):
        if b % 7:
            assert got[b] == total
            total += b % 5 + 1
