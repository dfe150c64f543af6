"""URL filter: rules by host and path first, then the ratio of two character language models.

The models are smoothed variable-order Markov models: at each character, the estimates of
orders 0 to ``order`` are mixed from the lowest up, each longer context weighing in by how
often it was seen against how many different characters followed it (Witten-Bell).  One
is fitted on accepted URLs and one on rejected ones; the verdict compares the difference
of their log-likelihoods per character with a threshold calibrated on labelled URLs that
were kept out of the fit.

All distinct URLs that rules decide are learned from, in whole, but for one in ``HELD_OUT`` of them,
told by a hash of the URL; all of these find the threshold, among steps of a ``STEPS``-th.
A URL seen any number of times counts once.  Counts are asked for and answered by blocks of
distinct URLs (``blocks``), so no task and not the driver has the whole model: the driver sees how many
held-out URLs have a score of each step, which is bounded as scores are.  Contexts are hashes of 48 bits;
characters whose codes differ by 65,534 count as one.

Null URLs and those without ``://`` have an empty host and path; a null or empty URL has a
score of 0.  A URL of any length is learned from and scored whole.  Repeated URLs get the same verdict, ties with the threshold are allowed.  With no
URL of one class to learn from, every score is 0 and what no rule decides is
allowed; with none of one class held out the threshold is 0.  An empty table gives no rows.  Input columns named like an added one are replaced.

A model that was fitted beforehand on lists of URLs (``fit_urls``) can be given instead; it is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import blocks as B
from packloom.llm.shared import stored
from packloom.llm.textvec import ODD, U, mix

#: Characters of a URL that ``labelled_sample`` takes.
MOST = 2000
#: One labelled URL in so many calibrates; steps of the threshold to one of the score.
HELD_OUT, STEPS = 5, 1024
#: Bytes of URLs in a block, and characters that a task looks at a time.
BLOCK, PIECE = 1 << 19, 1 << 18
#: Bits of a key that tell the next character; the first two codes hold how often its context was seen and how many characters followed it.
CHAR = 16
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does.

    A rule ``host/path`` fits its host and all subdomains where the URL's path starts with its path.
    """
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _coded(texts: list[str], order: int) -> list[np.ndarray]:
    """The characters of each text, with ``order`` signs before and one after them."""
    return [np.frombuffer(("\x02" * order + t + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


def _before(codes: list[np.ndarray], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the context before each character but the first ``order``; these characters, and the text of each."""
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, U)
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    real = np.flatnonzero(place >= order)
    context = np.zeros(len(real), U)
    before = []
    for k in range(order + 1):
        if k:
            context = context + (flat[real - k] + U(1)) * ODD[k]
        before.append(mix(context + U(k)))
    return before, flat[real], owner[real]


def _contexts(texts: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order: hash of the context before each character, hash of context and character; and the text of each character."""
    before, char, owner = _before(_coded(texts, order), order)
    return before, [mix(b + (char + U(1)) * ODD[20]) for b in before], owner


@dataclass
class CharModel:
    """Counts of every context and of every context with its next character."""

    order: int
    alphabet: int = 256
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, texts: list[str], order: int) -> CharModel:
        model = cls(order)
        for before, whole in zip(*_contexts(texts, order)[:2], strict=True):
            keys, first, counts = np.unique(whole, return_index=True, return_counts=True)
            contexts, back = np.unique(before[first], return_inverse=True)
            model.keys.append(keys)
            model.counts.append(counts)
            model.contexts.append(contexts)
            model.totals.append(np.bincount(back, weights=counts, minlength=len(contexts)))
            model.kinds.append(np.bincount(back, minlength=len(contexts)).astype(float))
        return model

    def log_prob(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log-likelihood, characters counted) of each text, its end included."""
        before, whole, owner = _contexts(texts, self.order)
        p = np.full(len(owner), 1.0 / self.alphabet)
        for k in range(self.order + 1):
            if not len(self.keys[k]):
                continue
            n, kinds = _look(self.contexts[k], self.totals[k], before[k]), _look(self.contexts[k], self.kinds[k], before[k])
            c = _look(self.keys[k], self.counts[k].astype(float), whole[k])
            p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)
        size = len(texts)
        return np.bincount(owner, weights=np.log(p), minlength=size), np.bincount(owner, minlength=size)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class UrlModel:
    accepted: CharModel
    rejected: CharModel
    threshold: float
    accuracy: float

    def score(self, urls: list[str]) -> np.ndarray:
        a, n = self.accepted.log_prob(urls)
        r, _ = self.rejected.log_prob(urls)
        return np.where([bool(u) for u in urls], (a - r) / np.maximum(n, 1), 0.0)


def fit_urls(accepted: list[str], rejected: list[str], order: int = 5, held_out: int = 5) -> UrlModel:
    """Every ``held_out``-th URL of each class calibrates: the threshold with the best balanced accuracy on those."""
    split = lambda urls: ([u for i, u in enumerate(urls) if i % held_out], urls[::held_out])
    (fit_a, test_a), (fit_r, test_r) = split(accepted), split(rejected)
    if not fit_a or not fit_r:
        same = CharModel.fit([], order)
        return UrlModel(same, same, 0.0, 0.5)
    model = UrlModel(CharModel.fit(fit_a, order), CharModel.fit(fit_r, order), 0.0, 0.0)
    a, r = model.score(test_a), model.score(test_r)
    cuts = np.unique(np.concatenate([a, r]))
    cuts = np.concatenate([[cuts[0] - 1e-6], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1e-6]])
    right = [(np.mean(a >= c) + np.mean(r < c)) / 2 for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    middle = best[np.argmin(np.abs(cuts[best]))]
    model.threshold, model.accuracy = float(cuts[middle]), float(right[middle])
    return model


def labelled_sample(urls: DataFrame, sample: int) -> tuple[list[str], list[str]]:
    """At most ``sample`` distinct URLs of each class from rows (url, verdict), by smallest hash, for a small model of ``fit_urls``; ``filter_urls`` itself learns from all."""
    out = []
    for what in ("allow", "block"):
        rows = urls.filter(F.col("verdict") == what).filter("url is not null").select(F.xxhash64("url").alias("h"), "url").distinct()
        out.append([r.url for r in rows.orderBy("h", "url").limit(sample).select(F.substring("url", 1, MOST).alias("url")).collect()])
    return out[0], out[1]


def pieces(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys by order and character, text of each character) of about ``PIECE`` characters at a time; longer texts are cut."""
    held, owners, n = [], [], 0

    def made():
        before, char, owner = _before(held, order)
        code = char % U((1 << CHAR) - 2) + U(2)
        return np.stack([(b >> U(CHAR) << U(CHAR)) | code for b in before]), np.array(owners)[owner]

    for i, codes in enumerate(_coded(texts, order)):
        for a in range(order, len(codes), PIECE):
            held.append(codes[a - order : a + PIECE])
            owners.append(i)
            n += len(held[-1])
            if n >= PIECE:
                yield made()
                held, owners, n = [], [], 0
    if held:
        yield made()


def _own(keys: np.ndarray) -> np.ndarray:
    """The keys' contexts, where how often they were seen is counted; the next code has their kinds of characters."""
    return keys >> U(CHAR) << U(CHAR)


def block_counts(texts: list[str], label: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending, with those of their contexts; counts in accepted and in rejected URLs that are learned from)."""
    parts = []
    for keys, owner in pieces(texts, order):
        found, back = np.unique(keys, return_inverse=True)
        what = np.tile(label[owner], len(keys))
        counts = [np.bincount(back.ravel(), weights=what == side, minlength=len(found)).astype(np.int64) for side in (1, -1)]
        context = np.unique(_own(found))
        none = np.zeros(2 * len(context), np.int64)
        parts.append((np.concatenate([found, context, context + U(1)]), *(np.concatenate([c, none]) for c in counts)))
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(back, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64) for k in (1, 2))


def with_contexts(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A bucket's counts, with how often each context was seen and its kinds of next characters in their places."""
    # All keys of a context are in one bucket, one after another.
    first = np.flatnonzero(keys >> U(bits) & U((1 << CHAR) - 1) == 0)
    out = counts.copy()
    out[first], out[first + 1] = np.add.reduceat(counts, first), np.add.reduceat((counts > 0).astype(np.int64), first)
    return out


def block_scores(texts: list[str], keys: np.ndarray, sides: list[np.ndarray], order: int) -> np.ndarray:
    """Score of each text; ``sides``: counts of ``keys`` in accepted and in rejected URLs, as ``with_contexts`` has them."""
    total = np.zeros(len(texts))
    for asked, owner in pieces(texts, order):
        found, back = np.unique(asked, return_inverse=True)
        back = back.reshape(asked.shape)
        at, context = np.searchsorted(keys, found), np.searchsorted(keys, _own(found))
        for sign, counts in zip((1, -1), sides, strict=True):
            c, n, kinds = (counts[i].astype(float) for i in (at, context, context + 1))
            p = np.full(len(owner), 1.0 / CharModel.alphabet)
            for k in back:
                p = np.where(n[k] > 0, (c[k] + kinds[k] * p) / np.maximum(n[k] + kinds[k], 1), p)
            total += sign * np.bincount(owner, weights=np.log(p), minlength=len(texts))
    return np.where([bool(t) for t in texts], total / (np.array([len(t) for t in texts]) + 1), 0.0)


def scored_urls(judged: DataFrame, order: int = 5, fan: int = B.FAN) -> DataFrame:
    """url, label, score of the distinct URLs of rows (url, verdict: null if no rule decides).

    ``label``: 1 for accepted and -1 for rejected URLs that are learned from, 2 and -2 for those held out, else 0.
    """
    side = F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", -1).otherwise(0)
    label = side * F.when(F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0, 2).otherwise(1)
    rows = stored(judged.filter("url is not null").select("url", label.cast("int").alias("label")).distinct(), clean=True)
    learned = {r.label for r in rows.select("label").distinct().collect()}
    if not {1, -1} <= learned:
        return rows.withColumn("score", F.lit(0.0))
    n_blocks, bits = B.plan_blocks(rows, "url", BLOCK)
    blocked = rows.select(B.block_of(n_blocks, "url").alias("block"), "url", "label")

    def ask(rows: pa.Table) -> pa.Table:
        keys, accepted, rejected = block_counts(rows["url"].to_pylist(), rows["label"].to_numpy(), order)
        return B.ask_rows(rows["block"][0].as_py(), keys, accepted, bits, 64 - bits, apart=rejected, fan=fan)

    asked = blocked.groupBy("block").applyInArrow(ask, B.ASK)
    answered = stored(B.answers(asked, bits, 64 - bits, fan=fan, finish=lambda keys, counts: with_contexts(keys, counts, bits)), clean=True)

    def score(rows: pa.Table, answer: pa.Table) -> pa.Table:
        texts, label = rows["url"].to_pylist(), rows["label"].to_numpy()
        keys, _, _ = block_counts(texts, label, order)
        scores = block_scores(texts, keys, [B.read_answers(answer, c) for c in ("counts", "apart")], order)
        return pa.table([rows["url"], rows["label"], pa.array(scores)], names=["url", "label", "score"])

    return stored(B.with_answers(blocked, answered, score, "url string, label int, score double"), clean=True)


def threshold_of(scored: DataFrame) -> float:
    """The step with the best balanced accuracy on the held-out URLs of ``scored``, of several the nearest to 0."""
    step = F.floor(F.col("score") * STEPS).cast("long")
    rows = scored.filter("abs(label) = 2").groupBy(step.alias("step")).agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") < 0).alias("r")).orderBy("step").collect()
    steps, a, r = (np.array([x[k] for x in rows], np.int64) for k in range(3))
    if not a.sum() or not r.sum():
        return 0.0
    cuts = np.unique(np.concatenate([steps, steps + 1, [0]]))
    below = np.searchsorted(steps, cuts)
    passed, stopped = a.sum() - np.append(0, np.cumsum(a))[below], np.append(0, np.cumsum(r))[below]
    right = (passed / a.sum() + stopped / r.sum()) / 2
    best = cuts[right >= right.max() - 1e-12]
    return float(best[np.argmin(np.abs(best))]) / STEPS


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", order: int = 5, model: UrlModel | None = None) -> DataFrame:
    """Add host, path, rule, score and verdict; input columns of these names are replaced.

    Without ``model``, all URLs that rules decide are its accepted and rejected ones.
    """
    url = F.col("_url")
    base = pages.withColumn("_url", F.col(url_col)).drop(*[c for c in ("host", "path", "rule", "score", "verdict") if c != url_col])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": rule, "verdict": verdict})
    if model is None:
        found = scored_urls(judged.select(url.alias("url"), "verdict"), order)
        threshold = threshold_of(found)
        scores = found.select(F.col("url").alias("_scored"), F.col("score").alias("_score"))
        scored = judged.join(scores.hint("shuffle_merge"), F.col("_url") == F.col("_scored"), "left").withColumn("score", F.coalesce("_score", F.lit(0.0))).drop("_scored", "_score")
    else:
        threshold = model.threshold
        shared = pages.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def score(urls: pd.Series) -> pd.Series:
            out = [shared.value.score(urls.iloc[i : i + 2000].fillna("").tolist()) for i in range(0, len(urls), 2000)]
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        scored = judged.withColumn("score", score(url))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("verdict", own)).drop("_url")
