"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often
the context was seen: contexts are bucketed by the logarithm of their frequency.  A fixed
part of the training documents is deleted from the counts; expectation-maximisation on
the deleted part's own counts finds each bucket's weights.  The scores then take the
counts of all training documents.

What EM needs of the deleted part is a histogram of likelihood ratios, summed in Spark:
its bins are bounded, its weights grow with the corpus.

Tokens are words with A-Z in lower case, then one end.  Null and empty texts have their
end only.  A null id belongs to fold 0, which is held out.  Repeated rows count and are
scored each.  Ids must be whole numbers, or text that reads as such.  A text of any length
is scored whole.  Without training documents, nothing is known and a token's estimate is 1.
An empty table gives no rows.  Columns other than id and text are left out, so none can
clash.  The order is fixed at two words: trigrams would take the counts beyond the disk
that a job of this kind is given (README.md).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm import blocks as B
from packloom.llm import textvec as V
from packloom.llm.shared import stored
from packloom.llm.textvec import U

END, START = U(0x1234567890ABCDEF), U(0x0FEDCBA987654321)
WIDTH = 48
STEPS = 4  # ratio bins to an octave
FLOOR = -400  # bin of an estimate of 0
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


@dataclass
class Stream:
    """Tokens of a block's documents, one document after another, ends included."""

    unigram: np.ndarray
    bigram: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    docs: int


def token_stream(texts: pa.ChunkedArray) -> Stream:
    texts = texts.combine_chunks()
    tokens, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in V.slices(texts):
        w = V.words(*V.raw(texts.slice(a, b - a)))
        n = b - a
        one = np.empty(len(w.hash) + n, U)
        one[np.arange(len(w.hash)) + w.text] = w.hash
        one[w.first[1:] + np.arange(n)] = END
        tokens.append(one)
        docs.append(np.repeat(np.arange(a, b), w.counts + 1))
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    context = np.empty(len(token), U)
    context[1:] = token[:-1]
    if len(token):
        context[0] = START
        context[1:][doc[1:] != doc[:-1]] = START
    return Stream(V.mix(token), V.mix(context * V.ODD[1] + token * V.ODD[2]), V.mix(context), doc, len(texts))


def ask_block(rows: pa.Table, bits: int, apart_from: int) -> pa.Table:
    """Unigrams in the first half of the buckets, bigrams in the second; counts are those of training documents.

    A context's count is its unigram's; the start is asked for as one, counted once a document.
    """
    s = token_stream(rows["text"])
    block, train = rows["block"][0].as_py(), rows["train"].to_numpy()
    weight = train[s.doc].astype(np.int64)
    first = V.mix(np.array([START]))
    out = []
    for half, keys, w in ((0, np.concatenate([s.unigram, first]), np.append(weight, int(train.sum()))), (1, s.bigram, weight)):
        distinct, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, weights=w, minlength=len(distinct)).astype(np.int64)
        out.append(B.ask_rows(block, distinct, counts, bits, WIDTH, half, counts if block >= apart_from else None))
    return pa.concat_tables(out)


def counts_of(rows: pa.Table, answer: pa.Table, column: str = "counts") -> tuple[Stream, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, counts of each token, of its context and of both together)."""
    s = token_stream(rows["text"])
    got = B.read_answers(answer, column)
    keys = np.unique(np.append(s.unigram, V.mix(np.array([START]))))
    pairs, back = np.unique(s.bigram, return_inverse=True)
    uni, bi = got[: len(keys)], got[len(keys) : len(keys) + len(pairs)]
    return s, uni[np.searchsorted(keys, s.unigram)], uni[np.searchsorted(keys, s.context)], bi[back]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 plus the whole binary logarithm of their count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


@dataclass
class Mixture:
    """Totals of the training documents and each bucket's weights of bigram, unigram and uniform estimates."""

    tokens: int
    kinds: int
    weights: dict[int, tuple[float, float, float]]

    def table(self) -> np.ndarray:
        return np.array([self.weights[b] for b in range(max(self.weights) + 1)])

    def log10(self, token: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
        table = self.table()
        w = table[np.minimum(bucket_of(context), len(table) - 1)]
        p2 = both / np.maximum(context, 1)
        p1 = token / max(self.tokens, 1)
        return np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (self.kinds + 1))


def em(bins: list[tuple[int, int, int, int]], rounds: int = 60) -> dict[int, tuple[float, float, float]]:
    """Weights per bucket from (bucket, bin of bigram to uniform, bin of unigram to uniform, tokens).

    A bucket without deleted tokens takes the weights of all of them together; contexts
    never seen have no bigram estimate and give it no weight.
    """
    def ratio(k):
        return np.where(k <= FLOOR, 0.0, 2.0 ** (np.maximum(k, FLOOR) / STEPS))

    def fit(rows, bigram=True):
        if not len(rows):
            return None
        p = np.stack([ratio(rows[:, 1]) * bigram, ratio(rows[:, 2]), np.ones(len(rows))], axis=1)
        w = np.array([0.4, 0.4, 0.2]) if bigram else np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = (share * rows[:, 3:4]).sum(axis=0) / rows[:, 3].sum()
        w = np.maximum(w, [0, 1e-9, 1e-9])
        return tuple(float(x) for x in w / w.sum())

    rows = np.array(bins, float).reshape(-1, 4)
    pooled = fit(rows[rows[:, 0] > 0]) or (0.4, 0.4, 0.2)
    unseen = fit(rows[rows[:, 0] == 0], bigram=False) or (0.0, pooled[1] / (pooled[1] + pooled[2]), pooled[2] / (pooled[1] + pooled[2]))
    return {0: unseen} | {b: fit(rows[rows[:, 0] == b]) or pooled for b in range(1, 65)}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, deleted: int = 20) -> DataFrame:
    """Scores of all documents by a model of those whose fold isn't 0; one in ``deleted`` of these finds the weights."""
    n_blocks, bits = B.plan_blocks(docs, text_col)
    n_apart = max(4, n_blocks // deleted)
    blocked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), fold(id_col).alias("f"))
    train, apart = F.col("f") % folds != 0, (F.col("f") % folds != 0) & (F.floor(F.col("f") / folds) % deleted == 0)
    block = F.when(apart, B.block_of(n_apart, "doc_id", "text") + n_blocks).otherwise(B.block_of(n_blocks, "doc_id", "text"))
    blocked = blocked.select("doc_id", "text", train.alias("train"), apart.alias("apart"), block.alias("block"))

    asked = blocked.drop("apart").groupBy("block").applyInArrow(lambda rows: ask_block(rows, bits, n_blocks), B.ASK)
    answered = stored(B.answers(asked, bits, WIDTH))
    sums = answered.filter(f"block = {B.SUMMARY} and bucket < {1 << bits}").agg(F.sum("n_distinct"), F.sum("total")).first()
    starts = blocked.filter("train").count()
    # The start isn't a token, though it is counted as one when there are training documents.
    kinds, tokens = int(sums[0] or 0) - (starts > 0), int(sums[1] or 0) - starts

    def ratios(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("bucket", "two", "one", "n")})
        kept = []
        s, *every = counts_of(rows, answer)
        _, *own = counts_of(rows, answer, "apart")
        kept = [a - b for a, b in zip(every, own, strict=True)]
        token, context, both = kept
        uniform = kinds + 1

        def binned(p):
            return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300) * uniform) * STEPS), FLOOR).astype(np.int64)

        two, one = binned(both / np.maximum(context, 1)), binned(token / max(tokens, 1))
        found, n = np.unique(np.stack([bucket_of(context), two, one]), axis=1, return_counts=True)
        return pa.table([*[pa.array(x) for x in found], pa.array(n.astype(np.int64))], names=["bucket", "two", "one", "n"])

    deleted_docs = blocked.filter("apart").drop("apart")
    deleted_answers = answered.filter(f"block >= {n_blocks}")
    bins = B.with_answers(deleted_docs, deleted_answers, ratios, "bucket long, two long, one long, n long")
    rows = bins.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    mixture = Mixture(tokens, kinds, em([(r.bucket, r.two, r.one, r.n) for r in rows]))

    def scored(rows: pa.Table, answer: pa.Table) -> pa.Table:
        s, token, context, both = counts_of(rows, answer)
        n = s.docs
        base = np.log10((token + 0.1) / (mixture.tokens + 0.1 * (mixture.kinds + 1)))
        per_doc = lambda x: np.bincount(s.doc, weights=x, minlength=n)
        return pa.table(
            [
                rows["doc_id"],
                pa.array(~rows["train"].to_numpy().astype(bool)),
                pa.array(np.bincount(s.doc, minlength=n).astype(np.int64)),
                pa.array(per_doc(token > 0).astype(np.int64)),
                pa.array(np.full(n, mixture.tokens, np.int64)),
                pa.array(per_doc(base)),
                pa.array(per_doc(mixture.log10(token, context, both))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return B.with_answers(blocked.drop("apart"), answered, scored, OUT)
