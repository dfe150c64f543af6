"""Toxicity scores: bags of subword vectors, averaged over short passages, into a linear softmax.

A word is what stands between white space, without the signs at its ends, A-Z in lower
case.  Its bag holds a vector for the whole word and for each of its character n-grams
(``GRAMS`` long, with marks at both ends), taken from one table of ``BUCKETS`` hashed rows.  So an
unseen misspelling has most of its vectors in common with the word it stands for.  The
vectors of a word are averaged, then those of the ``WINDOW`` words of a passage, and a softmax over the
two classes reads the average.  A text has the probability of its most toxic passage: one insult
in a very long text weighs as much as in a short one.

Table and softmax are trained together by Adam in numpy, first on soft maxima over the
passages of a text, later on the maximum.  In each round a share of a text's words, drawn anew for
the text, is misspelt; frequent words have more misspelt forms, as they cost no more.  As the softmax is linear, an n-gram counts in a
text only by the product of its vector with the difference of the class weights, so
scoring carries one number for each bucket.  Those are whole numbers, and sums of them don't
depend on how rows were batched.

Texts that train are a sample of bounded size (``sample`` documents of either class, of at most
``longest`` characters each), drawn by hash from the labelled rows outside the held-out
part; the sample's texts are the only ones that the driver sees.  All texts are scored whole.

Null and empty texts have no words and get the probability of none.  Repeated rows are
scored each.  Of labels that contradict each other none is learned; of the texts of a
repeated id one.  Null ids teach nothing, and neither do null labels.  With no label of one class nothing is learned
and every score is 0.  Columns of the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.textvec import LOWER, U, mix, raw, slices, spans_hash, words

GRAMS, BUCKETS, DIM, WINDOW = range(3, 7), 1 << 17, 8, 3
#: In how many ways a word is misspelt in training, one that occurs ``COMMON`` times or more in how many, and what replaces characters.
WAYS, COMMON, COMMON_WAYS, SIGNS = 2, 20, 32, "abcdefghijklmnopqrstuvwxyz0134@$*"
#: Signs that stand for a letter because they look like it.
ALIKE = {"a": "@", "b": "8", "e": "3", "g": "9", "i": "1", "l": "1", "o": "0", "s": "$", "t": "7"}
#: Log-odds of a passage of words that say nothing, before the even point moves them; the softmax's own biases stay at half of it.
NEUTRAL, DECAY = -4.0, 1e-6
#: Words whose parts are looked at at once in training.
BLOCK = 20_000
#: Parts of a unit of score.
UNIT = 1 << 20
#: Bytes that are letters or digits, or part of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word without the signs at its ends; ``data`` in lower case."""
    w = words(data, offsets, lower=False)
    solid = np.flatnonzero(ALNUM[data])
    a, b = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end) - 1
    has = b >= a
    start, end = solid[a[has]], solid[b[has]] + 1
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    return spans_hash(data, start, end, np.cumsum(mark[:-1]) > 0), w.text[has], start, end


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end, strict=True)]


def misspelt(told: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with one character dropped, doubled, replaced (by any sign or one that looks like it) or changed places with the next."""
    out = []
    for x, how, at, sign in zip(told, rng.integers(5, size=len(told)), rng.random(len(told)), rng.integers(len(SIGNS), size=len(told)), strict=True):
        i = int(at * len(x))
        new = ("", x[i] * 2, SIGNS[sign], ALIKE.get(x[i], "*"), x[i + 1 : i + 2] + x[i])[how]
        out.append(x[:i] + new + x[i + 1 + (how == 4) :])
    return out


def grams_of(told: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of all parts of these words, each word with at least one."""
    if not told:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    codes = np.frombuffer("".join(f"<{x}>" for x in told).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    size = np.fromiter((len(x) + 2 for x in told), np.int64, len(told))
    first = np.cumsum(size) - size
    word, left = np.repeat(np.arange(len(told)), size), np.repeat(first + size, size) - np.arange(len(codes))
    value = mix(codes + U(1))
    whole = np.add.reduceat(mix(value + (np.arange(len(codes)) - np.repeat(first, size)).astype(U) * U(0x9E3779B97F4A7C15)), first)
    bucket, owner = [mix(whole)], [np.arange(len(told))]
    rolled = np.zeros(len(codes), U)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        rolled[:m] = mix(rolled[:m] * U(3) + value[n - 1 :])
        if n in GRAMS:
            inside = np.flatnonzero(left[:m] >= n)
            bucket.append(rolled[inside] + U(n))
            owner.append(word[inside])
    return (np.concatenate(bucket) % U(BUCKETS)).astype(np.int32), np.concatenate(owner).astype(np.int32)


def passages(token: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, text number) of each passage of words with these text numbers, which ascend."""
    n = len(text)
    last = np.searchsorted(text, text, side="right")
    begin = np.searchsorted(text, text, side="left")
    at = np.arange(n)
    full = (at + WINDOW <= last) | (at == begin)
    at = at[full]
    return at, np.minimum(at + WINDOW, last[full]), text[full]


@dataclass
class Toxicity:
    """``weight``: what each bucket adds to the log-odds, in parts of 1 / UNIT; ``bias`` and the log-odds that count as even."""

    weight: np.ndarray
    bias: float
    even: float

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        data, offsets = raw(texts)
        data, n = LOWER[data], len(texts)
        out = np.full(n, np.iinfo(np.int64).min)
        key, text, start, end = bare_words(data, offsets)
        if len(key):
            _, first, token = np.unique(key, return_index=True, return_inverse=True)
            bucket, owner = grams_of(spelled(data, start[first], end[first]))
            sums = np.zeros(len(first), np.int64)
            np.add.at(sums, owner, self.weight[bucket])
            score = sums // np.bincount(owner, minlength=len(first))
            run = np.concatenate([[0], np.cumsum(score[token])])
            a, b, of = passages(token, text)
            np.maximum.at(out, of, (run[b] - run[a]) // (b - a))
        none = out == np.iinfo(np.int64).min
        return np.where(none, 0, out) / UNIT + self.bias - self.even

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities; 0 of all texts where nothing was learned."""
        if not len(self.weight):
            return np.zeros(len(texts))
        parts = [self.log_odds(texts.slice(a, b - a)) for a, b in slices(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30))) if parts else np.zeros(0)


def fit(texts: list[str], toxic: list[int], rounds: int = 100, seed: int = 7) -> Toxicity:
    """Vectors and softmax of these texts.  Every fifth one only sets the even point, the one with the best balanced accuracy."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Toxicity(np.zeros(0, np.int64), NEUTRAL, 0.0)
    data, offsets = raw(pa.array(texts, pa.large_string()))
    data = LOWER[data]
    test = np.zeros(len(y), bool)
    for c in (0, 1):
        test[np.flatnonzero(y == c)[::5][1:]] = True
    key, text, start, end = bare_words(data, offsets)
    learns = ~test[text]
    key, text, start, end = key[learns], text[learns], start[learns], end[learns]
    _, first, token = np.unique(key, return_index=True, return_inverse=True)
    rng, told = np.random.default_rng(seed), spelled(data, start[first], end[first])
    ways = np.where(np.bincount(token) >= COMMON, COMMON_WAYS, WAYS)
    base = len(first) + np.cumsum(ways) - ways
    told += misspelt([told[i] for i in np.repeat(np.arange(len(first)), ways)], rng)
    blocks = [(k, len(told[k : k + BLOCK]), *grams_of(told[k : k + BLOCK])) for k in range(0, len(told), BLOCK)]
    parts = np.concatenate([np.bincount(owner, minlength=n) for _, n, _, owner in blocks])
    a, b, of = passages(token, text)
    docs, begin = np.unique(of, return_index=True)
    place = np.repeat(np.arange(len(docs)), np.diff([*begin, len(of)]))
    own = np.searchsorted(docs, text)
    share = np.where(y[docs] == 1, 0.5 / max(1, (y[docs] == 1).sum()), 0.5 / max(1, (y[docs] == 0).sum()))
    table, soft = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, (2, DIM))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft)]
    for t in range(1, rounds + 1):
        v = soft[1] - soft[0]
        value = table @ v
        word = np.concatenate([np.bincount(owner, value[bucket], n) for _, n, bucket, owner in blocks]) / parts
        wrong = rng.random(len(token)) < rng.random(len(docs))[own]
        seen = np.where(wrong, base[token] + (rng.random(len(token)) * ways[token]).astype(np.int64), token)
        run = np.concatenate([[0], np.cumsum(word[seen])])
        z = (run[b] - run[a]) / (b - a)
        top = np.maximum.reduceat(z, begin)
        heat = 0.5 * 1.06**t
        p = np.exp(np.clip(heat * (z - top[place]), -60, 0))
        p /= np.add.reduceat(p, begin)[place]
        odds = np.add.reduceat(p * z, begin) + NEUTRAL
        slope = share * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[docs])
        each = slope[place] * p / (b - a)
        edge = np.bincount(a, each, len(token) + 1) - np.bincount(b, each, len(token) + 1)
        of_word = np.bincount(seen, np.cumsum(edge)[:-1], len(told)) / parts
        of_bucket = sum(np.bincount(bucket, of_word[k : k + n][owner], BUCKETS) for k, n, bucket, owner in blocks)
        dv = of_bucket @ table
        slopes = (np.outer(of_bucket, v) + DECAY * table, np.stack([-dv, dv]))
        for q, g, m in zip((table, soft), slopes, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            q -= 0.05 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)
    model = Toxicity(np.rint(table @ (soft[1] - soft[0]) * UNIT).astype(np.int64), NEUTRAL, 0.0)
    held = np.flatnonzero(test)
    if len(set(y[held])) == 2:
        odds = np.concatenate([model.log_odds(pa.array([texts[i]], pa.large_string())) for i in held])
        model.even = even_point(odds[y[held] == 1], odds[y[held] == 0])
    return model


def even_point(toxic: np.ndarray, clean: np.ndarray) -> float:
    """Between the log-odds of both classes: the middle of the cuts of the best balanced accuracy."""
    cuts = np.unique(np.concatenate([toxic, clean]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    right = (toxic >= cuts[:, None]).mean(1) + (clean < cuts[:, None]).mean(1)
    best = cuts[right >= right.max() - 1e-12]
    return float((best[0] + best[-1]) / 2)


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, longest: int) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled documents of either class, by the hash of their id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    agreed = own.filter(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    drawn = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # 2 * sample rows at most
    short = docs.filter(F.length(text_col) <= longest).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = short.join(chosen.hint("broadcast"), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.y, str(r.id)))
    return [r.text for r in rows], [r.y for r in rows]


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000, longest: int = 10_000, model: Toxicity | None = None) -> DataFrame:
    """Add held_out, score (0 to 1) and predicted (1 from 0.5 on); without ``model``, one is trained from ``labels``."""
    if model is None:
        model = fit(*training_texts(docs, labels, id_col, text_col, label_col, sample, longest))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("held_out", "score", "predicted")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 9))], names=[*names, "score"])

    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields]).add("score", "double")
    scored = rows.mapInArrow(run, schema)
    return scored.select("*", held_out(id_col).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
