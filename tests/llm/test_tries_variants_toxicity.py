"""Prefix tries, spelling variants and toxicity scores on small tables against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import WORDS, low, prose

from packloom.llm import spelling, toxicity, trie


def rebuilt_by_hand(rows):
    """conv_id to its rebuilt turns: (role, text) in order."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        out[c] = own.get(c - rest, [])[:h] + ts[h:]
    return out


def trie_by_hand(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, out = Counter(k[:-1] for k in members if k), set()
    for k, cs in members.items():
        under = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(k))
        out.add((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(not kids[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def talk(seed, convs, kinds=3, most=7):
    rng = np.random.default_rng(seed)
    return [(int(c), t, ["user", "assistant", None][rng.integers(3)] if t % 3 else "user", ["a", "é", None, "long " * 3][rng.integers(kinds)], 9) for c in range(convs) for t in range(rng.integers(1, most))]


def found_trie(spark, rows, parts=4):
    turns = spark.createDataFrame([r if len(r) == 5 else (*r, 9) for r in rows], SCHEMA).repartition(parts)
    return [tuple(r) for r in trie.trie(trie.sequences(trie.rebuilt(trie.numbered(turns)))).select(trie.OUT).collect()]


@pytest.mark.parametrize("seed, convs, kinds", [(1, 90, 2), (2, 60, 4), (3, 3, 4)])
def test_tries(spark, seed, convs, kinds):
    rows = talk(seed, convs, kinds)
    got = found_trie(spark, rows)
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(rebuilt_by_hand([r[:4] for r in rows]))


def test_tries_of_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (-3, 0, "u", "q"), (-5, None, "u", "q"), (-5, 0, None, None), (4, 1, "a", "r"), (4, 1, "a", "r"), (4, None, "u", "r"), (0, 0, "u", "q"), (1, 0, "u", "q"), (7, 0, "u", "x" * 100_000)]
    rows += [(50, t, "u", f"t{t % 2}") for t in range(400)] + [(60, t, "u", f"t{t % 2}") for t in range(390)]
    rows += [(1000 + i, t, "u", "same") for i in range(40) for t in range(12)]
    got = found_trie(spark, rows)
    want = trie_by_hand(rebuilt_by_hand(rows))
    assert set(got) == want and len(got) == len(want)
    assert found_trie(spark, []) == []


def test_tries_cut_anywhere():
    """Parts of any cuts of the sorted conversations give the nodes of the whole."""
    rng = np.random.default_rng(5)
    convs = {i: [("u", "ab"[rng.integers(2)]) for _ in range(rng.integers(0, 5))] for i in range(40)}
    step = lambda t: hashlib.md5(t[1].encode()).digest() + len(t[1]).to_bytes(8, "big")
    rows = sorted((b"".join(map(step, ts)), c) for c, ts in convs.items())
    for cuts in ([0, 40], [0, 1, 2, 40], [0, 13, 14, 30, 40], list(range(41))):
        tables = [trie.nodes_of(np.array([c for _, c in rows[a:b]]), [k for k, _ in rows[a:b]]) for a, b in zip(cuts, cuts[1:])]
        all_rows = [r for t in tables for r in t.to_pylist()]
        parts = defaultdict(list)
        for r in all_rows:
            if r["kind"] == trie.PART:
                parts[r["node"]].append(r)
        merged = [ps[0] | {"conv_id": min(p["conv_id"] for p in ps)} | {c: sum(p[c] for p in ps) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")} for ps in parts.values()]
        names = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size"]
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 7]
        batch = pa.RecordBatch.from_arrays([pa.array([m[n] for m in merged], t) for n, t in zip(names, types)], names=names)
        joints = [r for b in trie.add_up([batch]) for r in b.to_pylist()]
        above = {r["node"]: r["conv_id"] for r in joints}
        pieces = sorted((r["node"], r["conv_id"], r["ids"]) for r in all_rows if r["kind"] == trie.ENDS)
        batches = [pa.RecordBatch.from_arrays([pa.array([p[0]], pa.binary()), pa.array([p[1]]), pa.array([p[2]])], names=["node", "conv_id", "ids"]) for p in pieces]
        ends = {r["node"]: r["sha"] for b in trie.hash_pieces(batches) for r in b.to_pylist()}
        got = [tuple((r | {"ends_sha256": ends.get(r["node"], hashlib.sha256(b"").hexdigest())})[c] for c in trie.OUT) for r in joints]
        got += [tuple((r | {"parent_conv_id": above[r["parent"]] if r["parent"] else r["parent_conv_id"]})[c] for c in trie.OUT) for r in all_rows if r["kind"] == trie.WHOLE]
        assert len(got) == len(set(got)) and set(got) == trie_by_hand(convs)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n, times=10):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, os in near.items():
        best = min(os, key=lambda o: (-n[o], o.encode())) if os else None
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_near_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 6)
    rng = np.random.default_rng(3)
    words = {"".join("abé"[k] for k in rng.integers(3, size=rng.integers(6, 10))) for _ in range(220)}
    words |= {"preface" + x for x in "abcdefghijklmnopqrstuvw"} | {x + "suffixed" for x in "abcdefghijklmn"} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000, "x" * 2999, "a\U0001f600bcdefg", "abcdefg"}
    n = {w: int(2 * 11.0 ** rng.integers(0, 4)) + int(rng.integers(2)) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == variants_by_hand(n)


def test_words_of_documents(spark):
    texts = [None, "", "Banana banana BANANA", "señorita SEÑORITA Ünterwasser ünterwasser", "river-stones under_bridges 123", "abc " * 50_000 + "lastword lastword"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "banana bananas bananas", "clash"), (3, texts[3], "clash"), (3, texts[3], "clash")]
    rows += [(100 + i, " ".join(f"{w}ingly" for w in WORDS), "clash") for i in range(30)]
    want = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    want = {w: n for w, n in want.items() if n >= 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = spelling.count_words(docs, drop_every=31)
    assert {(r.word, r.n) for r in counts.collect()} == set(want.items())
    assert {tuple(r) for r in spelling.variants(counts).collect()} == variants_by_hand(want)
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w13"), ("b", "a")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in chain}


BAD = ["snarkel", "grumbleton", "wretchling"]


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = prose(seed * 1000 + i, int(rng.integers(5, 80)))
        if i % 3 == 0:
            at = int(rng.integers(len(text)))
            text = f"{text[:at]} {BAD[i // 3 % 3]}, {text[at:]}"
        out.append((i, text, int(i % 3 == 0)))
    return out


def test_toxicity(spark):
    rows = labelled(600, 1)
    odd = [(None, BAD[0]), (900, None), (901, ""), (902, "  \n "), (903, "Snarkell! you gumbleton"), (904, prose(9, 4000) + " wretchlings " + prose(8, 4000)), (905, prose(7, 8000)), (903, "Snarkell! you gumbleton"), (906, "***")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*o, "x") for o in odd], "doc_id long, text string, score string").repartition(5)
    labels = [(i, y) for i, _, y in rows] + [(901, None), (None, 1), (600, 1), (600, 0), (0, 1)]
    made = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=150)
    got = made.collect()
    assert len(got) == 609 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by, truth = defaultdict(list), {i: y for i, _, y in rows}
    for r in got:
        by[r.doc_id].append(r)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 90 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [by[i][0].predicted for i in (900, 901, 902, 903, 904, 905, 906)] == [0, 0, 0, 1, 1, 0, 0] and by[None][0].predicted == 1
    assert by[900][0].score == by[901][0].score == by[902][0].score and len(by[903]) == 2 and by[903][0].score == by[903][1].score
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, ones).collect()} == {0.0}


def test_toxicity_does_not_hang_on_batches():
    rows = labelled(90, 2)
    model = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows], rounds=15)
    texts = [t for _, t, _ in rows] + [None, "", "é\U0001f600", "x" * 50_000]
    whole = model.score(pa.array(texts, pa.string()))
    single = [model.score(pa.array([t], pa.string()))[0] for t in texts]
    assert whole.tolist() == single
    # The passage's score by hand, from the words' buckets.
    for t, s in zip(texts[:20], whole):
        ws = [x for x in (re.sub(r"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$", "", w) for w in re.findall(r"[^\x20\x09-\x0D]+", low(t))) if x]
        each = []
        for w in ws:
            bucket, _ = toxicity.grams_of([w])
            assert len(bucket) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS)
            each.append(int(model.weight[bucket].sum()) // len(bucket))
        k = toxicity.WINDOW
        tops = [sum(each[i : i + k]) // len(each[i : i + k]) for i in range(max(1, len(each) - k + 1))]
        odds = max(tops) / toxicity.UNIT + model.bias - model.even
        assert s == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -30, 30))), abs=1e-12)
