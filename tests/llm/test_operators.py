"""Every operator on small tables with nulls, empty texts, repeated rows, ties and clashing columns, against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F
from samples import NEAR, ROWS, SCHEMA, TEXTS, WORDS, low, prose, words

from packloom.llm import chat, components, decontaminate, jaccard, licenses, lines, lm, mixing, quality, sharding, urls


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(spark):
    mit = "Released under the MIT License."
    notice = licenses.TEMPLATES[0][1].upper()
    cut = " ".join(notice.split()[:-3])
    rows = [(1, f"a b {mit} x {mit}"), (2, prose(1, 50) + " " + notice), (3, cut), (4, " ".join(notice.split()[:8])), (5, None), (6, ""), (7, "the mit  LICENSE"), (7, "the mit  LICENSE")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels, got[1].n_words) == (2, 5, 11, "mit", 13)
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[2].score == 1.0
    assert got[3].labels == "mit" and 0.8 <= got[3].score < 1 and got[4].labels == ""
    assert (got[5].n_words, got[5].score, got[5].first_word) == (0, 0.0, None) and got[7].base_labels == "mit"
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_license_texts(spark, nothing):
    """A full text in the middle of another, one with a fifth of its words gone, and half of one."""
    full = max(licenses.TEMPLATES, key=lambda t: len(t[1]))[1]
    ws = full.split()
    fewer = [w for w in ws if sorted(set(ws)).index(w) % 6]
    isc = next(t for label, t in licenses.TEMPLATES if label == "isc")
    rows = [(1, f"{prose(1, 300)} {full.title()} {prose(2, 300)}"), (2, f"{prose(3, 100)} {' '.join(fewer)}"), (3, prose(4, 2000)), (4, f"{prose(6, 70)} {isc} {isc}"), (5, " ".join(isc.split()[: len(isc.split()) // 2]))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and "mit" in got[2].labels and got[3].labels == "" and got[4].labels == "isc" and got[5].labels == ""
    assert licenses.scan_licenses(nothing).count() == 0 and got[1].n_words == 600 + len(ws)


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "a>b<%", "<~turn x"), (2, 0, None, None), (3, 1, "assistant", "b"), (3, 0, "assistant", "é\n"), (None, 0, "user", "q")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == len(said) and got[1].n_examples == 2
    import hashlib

    told = "".join(f"{r}\n{t}\n" for r, t in (("user", said), ("assistant", said), ("a>b<%", "<~turn x")))
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256("é\nb".encode()).hexdigest() and got[3].n_examples == 2
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 0
    first = made.filter("conv_id = 3 and example = 0").first()
    assert "b" not in first.text and first.text[first.loss_start : first.loss_end] == "é\n"


def test_lm(docs, nothing):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    tokens = {r[0]: [*words(low(r[1])), None] for r in ROWS}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    assert lm.score(nothing).count() == 0


def test_em_finds_the_mixture():
    # Bigram estimates 16 times the uniform one explain three tokens of four.
    w = lm.em([(3, 16, 0, 750), (3, lm.FLOOR, 0, 250), (0, lm.FLOOR, 4, 10)])
    assert w[3][0] > 0.5 and w[0][0] == 0 and all(abs(sum(x) - 1) < 1e-9 for x in w.values())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 102), (5, 5), (None, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


def sets(t, k):
    w = words(low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard(docs, size, percent):
    family = [" ".join(w if (i * 7 + k) % 41 else f"v{i}" for k, w in enumerate(TEXTS[3].split())) for i in range(30)]
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(family)], "doc_id long, text string"))
    got = {r.doc_id: r for r in jaccard.jaccard_components(more, size=size, percent=percent, members=8).collect()}
    s = {r[0]: sets(r[1], size) for r in [*ROWS, *[(100 + i, t) for i, t in enumerate(family)]]}
    up = {i: i for i in s}
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            low_, high = sorted((up[a], up[b]))
            up = {k: low_ if v == high else v for k, v in up.items()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), up[i]) for i in s}


def test_jaccard_edges(spark, nothing):
    rows = [(7, TEXTS[0]), (7, TEXTS[0]), (None, TEXTS[0]), (9, NEAR), (None, TEXTS[1]), (3, None), (4, ""), (5, "x")]
    out = jaccard.jaccard_components(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, g int")).collect()
    got = Counter((r.doc_id, r.component_id) for r in out)
    assert got == Counter({(7, 7): 2, (None, 7): 1, (9, 7): 1, (None, None): 1, (3, 3): 1, (4, 4): 1, (5, 5): 1})
    assert jaccard.jaccard_components(nothing).count() == 0


def test_links_between_groups_of_one_common_passage(spark):
    """Documents that share their rarest shingles without being similar: the second round finds the pairs that are."""
    shared = prose(300, 12)
    texts = [f"{prose(400 + i // 2, 40)} {shared}" + (" end" if i % 2 else "") for i in range(16)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=90, members=2).collect()}
    assert got == {i: i - i % 2 for i in range(16)}


@pytest.mark.parametrize("bits, fan", [(3, 8), (5, 2), (6, 1)])
def test_counts_come_back_over_any_number_of_hops(spark, bits, fan):
    from packloom.llm import blocks as B
    from packloom.llm.shared import stored

    rng = np.random.default_rng(bits)
    asks = {b: np.unique(rng.integers(0, 1 << 64, 200, dtype=np.uint64) >> np.uint64(54) << np.uint64(54) | np.uint64(5)) for b in range(40)}
    counts = {b: rng.integers(0, 5, len(k)) for b, k in asks.items()}

    def ask(rows):
        b = rows["b"][0].as_py()
        return B.ask_rows(b, asks[b], counts[b], bits, 48, apart=counts[b] if b >= 30 else None, fan=fan)

    blocks = spark.range(40).select(F.col("id").cast("int").alias("b"))
    got = stored(B.answers(blocks.groupBy("b").applyInArrow(ask, B.ASK), bits, 48, fan=fan)).toArrow()
    total, alone = Counter(), Counter()
    for b, k in asks.items():
        for key, n in zip(k.tolist(), counts[b].tolist(), strict=True):
            total[key] += n
            alone[key] += n * (b >= 30)
    for b, k in asks.items():
        mine = got.filter(pa.compute.equal(got["block"], b))
        assert B.read_answers(mine).tolist() == [total[x] for x in k.tolist()]
        if b >= 30:
            assert B.read_answers(mine, "apart").tolist() == [alone[x] for x in k.tolist()]
    sums = got.filter(pa.compute.equal(got["block"], B.SUMMARY))
    assert sum(sums["total"].to_pylist()) == sum(total.values()) and sum(sums["n_distinct"].to_pylist()) == sum(n > 0 for n in total.values())
    assert Counter(got["block"].to_pylist()).most_common(1)[0][1] <= max(1 << bits, 1 << fan)


def test_decontamination(spark, docs, nothing):
    item = " ".join(TEXTS[5].split()[10:40])
    edited = item.split()
    edited[3] = "zzz"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Two words"), (5, " ".join(edited)), (1, item), (6, prose(99, 30))], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.search(docs, items).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        for j, x in [(1, item), (4, "Two words"), (5, " ".join(edited)), (1, item)]:
            k = min(5, len(words(x)))
            a, w = sets(x, k), words(low(t))
            b = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)}
            if 100 * len(a & b) >= 80 * len(a):
                want[i, j] += 1
    assert got == want and sum(want.values()) > 2
    clean = decontaminate.drop_contaminated(docs, items, part_items=2)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in ROWS} - {i for i, _ in want} and clean.columns == docs.columns
    assert decontaminate.search(nothing, items).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs, max_repeats=2.0).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == {r[0] for r in ROWS} and max(times.values()) <= 2
    assert all(sorted(r.epoch for r in rows if r.doc_id == i) == list(range(n)) for i, n in times.items())
    assert mixing.mix(nothing).count() == 0


def test_exponents(spark):
    totals = spark.createDataFrame([("a", 800), ("b", 100), ("c", 100)], "_source string, tokens long")
    a = mixing.find_exponent(totals, max_repeats=2.0)
    assert a == pytest.approx(1 - math.log(2) / math.log(8), abs=2e-6)
    e = mixing.find_exponent(totals, entropy=1.0)
    w = np.array([8.0**e, 1, 1]) / (8.0**e + 2)
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-4)


def test_sharding(docs, nothing):
    rows = sharding.shard(docs.union(docs.limit(1)), 4).collect()
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sharding.shard(nothing, 4).count() == 0
    for n in (1, 2, 3, 17, 1000):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 5, inverse=True) == np.arange(n)).all()


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def test_urls(spark):
    rows = [(1, "https://WWW.example.com/en/1?q"), (2, "http://x.example.com/en/2"), (3, "a://b.com"), (4, None), (5, "no scheme"), (6, "http://notcom/fr/"), (7, "s://q.net/fr/x#t"), (8, "http://h.net/en://x"), (8, "http://h.net/en://x")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 9)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("x.example.com", "/en/2", "example.com/en/"), ("b.com", "", None), ("", "", None),
        ("", "", None), ("notcom", "/fr/", None), ("q.net", "/fr/x", "net/fr/"), ("h.net", "/en://x", None),
    ]
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[2].verdict == "block"


def test_url_sample_is_of_distinct_urls(spark):
    rows = [("a://hot", "allow")] * 50 + [(f"a://{i}", "allow") for i in range(6)] * 3 + [("b://one", "block")] * 9 + [(None, "block"), ("c://open", None)]
    good, bad = urls.labelled_sample(spark.createDataFrame(rows, "url string, verdict string"), 5)
    assert len(good) == len(set(good)) == 5 and bad == ["b://one"]
    good, _ = urls.labelled_sample(spark.createDataFrame(rows, "url string, verdict string"), 50)
    assert set(good) == {"a://hot"} | {f"a://{i}" for i in range(6)}


def test_url_model_tells_classes_apart():
    good = [f"https://{a}{b}.org/news/{i}" for i, (a, b) in enumerate(itertools.product(("river", "stone", "hill"), WORDS))]
    bad = [f"http://cheap-{a}-pills{b}.biz/win?{i}" for i, (a, b) in enumerate(itertools.product(("buy", "bet", "casino"), WORDS))]
    model = urls.fit_urls(good, bad)
    assert model.accuracy > 0.9 and (model.score(good) >= model.threshold).mean() > 0.9 and (model.score(bad) < model.threshold).mean() > 0.9


def test_quality(docs, nothing):
    repeated = [(200, "a b c " * 40, "en"), (201, "x y\nx y\n \n \nx y", "de"), (202, "WIN!! NOW!! ### $$$ | <> " * 20 + prose(3, 80), "en")]
    all_rows = [r[:3] for r in ROWS] + repeated
    got = {r.doc_id: r for r in quality.quality_rules(docs.sparkSession.createDataFrame(all_rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in all_rows:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        again = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(nothing).count() == 0 and quality.quality_rules(docs).columns.count("n_words") == 1


def test_lines(spark):
    line = "The quiet river runs under the old bridge while rain sings over roofs 12"
    rows = [(1, f"{line}\nshort\nshort"), (2, f"{line.upper()}!!\nanother line that nobody else has at all"), (3, line.replace("sings", "singt").replace("12", "99")), (4, None), (5, ""), (6, "\n\n"), (0, "unrelated words stand here all alone today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[1].text == f"{line}\nshort\nshort" and got[2].text == "another line that nobody else has at all" and got[3].text == ""
    assert [got[i].n_dropped for i in range(7)] == [0, 0, 1, 1, 0, 0, 0] and got[4].text is None and got[6].text == "\n\n"


def distance(x, y):
    before = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        now = [i]
        for j, b in enumerate(y, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return before[-1]


def normal(line):
    return " ".join(re.sub("[1-9]", "0", re.sub(r"[\W_]+", " ", line.lower())).split())


def near_lines(a, b):
    x, y = a.split(), b.split()
    if max(len(x), len(y)) <= lines.SHORT:
        x, y = a, b
    return distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)


def test_lines_against_all_pairs(spark):
    """Lines of 6 to 150 words and copies with words replaced, put in and left out: at least nine links of ten are found, and no other."""
    rng = np.random.default_rng(8)
    said = []
    for k in range(90):
        one = prose(700 + k, int(rng.choice([6, 9, 14, 22, 40, 150]))).split()
        said.append(" ".join(one))
        for _ in range(2):
            two = list(one)
            for _ in range(max(1, len(two) // 15)):
                at = int(rng.integers(len(two)))
                two[at : at + int(rng.integers(0, 2))] = ["changed", "of"][: int(rng.integers(0, 2))]
            said.append(" ".join(two))
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    dropped = {r.doc_id for r in lines.decisions(docs).collect()}
    forms = [normal(t) for t in said]
    up, links = list(range(len(said))), 0
    for a, b in itertools.combinations(range(len(said)), 2):
        if min(len(forms[a].split()), len(forms[b].split())) >= 5 and near_lines(forms[a], forms[b]):
            links += 1
            low_, high = sorted((up[a], up[b]))
            up = [low_ if v == high else v for v in up]
    want = {i for i in range(len(said)) if up[i] != i}
    assert links > 150 and dropped <= want and len(dropped) >= 0.9 * len(want)


def test_lines_of_one_common_passage_are_told_apart(spark):
    passage = "quiet river stones under the old bridge where boats sleep all day"
    said = [f"{passage} {prose(900 + i, 14)}" for i in range(30)]
    said += [said[3] + " again", said[4].replace("boats", "ships")]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r.doc_id for r in lines.decisions(docs).collect()} == {30, 31}


def test_line_edges(spark, nothing):
    long = prose(5, 20_000)
    rows = [(1, long + "\n" + long), (2, long.replace("river", "RIVER!")), (3, "\n".join(["a b c d e f g"] * 3)), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, "nobody else says this at all"), (4, None)]
    got = {(r.doc_id, tuple(r.dropped)) for r in lines.decisions(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, keys string")).collect()}
    assert got == {(1, (1,)), (2, (0,)), (3, (0, 1, 2))}
    assert lines.decisions(nothing).count() == 0 and lines.dedup_lines(nothing).count() == 0


def test_one_edit_in_each_half_of_a_line(spark):
    line = "quiet river stones under bridge where old boats sleep while rain sings"
    rows = [(1, line), (2, line.replace("stones", "stonis").replace("sleep", "slept")), (3, line.replace("rain", "raid").replace("river", "rivet").replace("where", "were"))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1]


def test_equal_short_lines(spark, tmp_path):
    from packloom.llm import queries

    rows = [(1, "Read more\nMenu\n\n--"), (2, "read MORE!\n\nmenus\n--\nread more now"), (3, "x\nMENU.\nx"), (None, "menu"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.dropped or "") for r in queries.op4_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (4, "1"), 2: (5, "0"), 3: (3, "1,2"), None: (1, ""), 5: (0, "")}


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline as P

    a, b, c, d = TEXTS[6], TEXTS[7], TEXTS[8], TEXTS[9]
    near = a.replace(a.split()[30], "CHANGED", 1)
    rows = [(5, a, "en"), (5, a, "en"), (5, b, "en"), (3, near, None), (7, b, "de"), (None, c, "en"), (None, c, "en"), (None, None, "en"), (None, d, "en"), (9, d, "en"), (3, TEXTS[10], "en"), (8, " \n", "en"), (8, " \n", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = P.drop_near_duplicates(spark, docs, "")
    want = [(3, near, None), (5, b, "en"), (None, c, "en"), (None, None, "en"), (9, d, "en"), (3, TEXTS[10], "en"), (8, " \n", "en"), (8, " \n", "en")]
    assert Counter(map(tuple, out.collect())) == Counter(want) and out.columns == docs.columns
    assert P.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_leaves_other_columns_alone(spark, tmp_path):
    import corpus_pipeline as P

    names = "kept n_words weight epoch block_order n_tokens char_distance row_no _w base_failed".split()
    rows = [(i, t, "en", "s", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, *names), (2, *rows[2][1:])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        for r in out.collect():
            assert r.doc_id is None or all(r[n] == f"{n}{r.doc_id}" for n in names)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0 and {"row_no", "shard", "slot"} <= set(empty.columns)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    clean = [(i, " ".join(t.split()[k] if k % 9 else t.split()[k] + "." for k in range(60)), "en", f"s{i % 2}") for i, t in enumerate(TEXTS[:10])]
    rows = [*clean, (50, clean[2][1], "en", "s0"), (51, prose(77, 70) + " " + TEXTS[19], "en", "s1"), (52, "spam " * 100, "en", "s1"), (53, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(TEXTS[19].split()[5:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path), str(tmp_path / "work")).collect()
    assert {r.doc_id for r in out} <= set(range(10)) and len(P.STAGES) == 5
    ids = [{r.doc_id for r in spark.read.parquet(str(tmp_path / f"work/{i}")).collect()} for i in range(5)]
    assert 52 not in ids[0] and 50 not in ids[1] and 51 not in ids[2] and ids[3] == ids[2] == ids[4]
    rows_at = lambda i: spark.read.parquet(str(tmp_path / f"work/{i}")).collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = lambda rs: Counter(tuple(r[n] for n in names) for r in rs)
    mixed, kept = plain(rows_at(3)), plain(rows_at(2))
    # The smaller source repeats its documents until both weigh what their exponent says, no document more than twice.
    assert set(mixed) == set(kept) and max(mixed.values()) <= 2 and max(kept.values()) == 1
    tokens = Counter()
    for k in kept:
        tokens[k[3]] += len(words(k[1]))
    large = max(tokens, key=lambda x: (tokens[x], x))
    assert all(n == 1 for k, n in mixed.items() if k[3] == large)
    placed = rows_at(4)
    assert plain(placed) == mixed and max(Counter(r.shard for r in placed).values()) - (len(placed) // 16) <= 1
    for s in range(16):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
