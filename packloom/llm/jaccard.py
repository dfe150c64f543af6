"""Exact n-gram Jaccard join by a token-group matrix.

1. A document is the set of its distinct word shingles.  Documents with the same set are
   one class; only classes are compared.
2. Document frequencies of all shingles order them, rarest first.  Two sets that are
   similar enough share one of their first few shingles (their prefixes); shingles that
   one document alone holds can't be shared and drop out.
3. Classes are dealt into groups of similar sets (same smallest hash), large groups into
   chunks.  The matrix says which groups hold a shingle in some prefix.  Only groups that
   share one are brought together.
4. Each query set's overlap with the other group's union of shingles bounds its
   similarity with all its sets; a group opens only for the queries whose bound reaches
   the threshold, and those pairs are counted exactly.

Every link is counted, but a pair of groups sends one row per linked class, not one per
link.  Groups that share a shingle of their prefixes are all compared, so the work grows
with the square of a family of near copies that aren't equal.  Null and empty texts have no
shingles and link with nothing; a text with fewer words than a shingle is one shingle of all
its words.  A text of any length is one set of 8 bytes a shingle.  Repeated rows are copies
of one class.  A null document id takes its class's component.  Ids must be whole numbers,
or text that reads as such.  An empty table gives no rows.  Input columns other than id and
text are left out, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm import blocks as B
from packloom.llm import textvec as V
from packloom.llm.components import components
from packloom.llm.shared import cut, stored
from packloom.llm.textvec import U

CARD = "doc_id long, n_shingles long, sig binary, lead long, tokens array<long>, shingles binary"
SALTS = 16


def doc_sets(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and their offsets."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts, counts = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for a, b in V.slices(texts):
        w = V.words(*V.raw(texts.slice(a, b - a)))
        values, offsets = V.distinct(*V.shingles(w, size), b - a)
        parts.append(values)
        counts.append(np.diff(offsets))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shingles that a set of n must share with a similar one."""
    return -(-n * percent // 100)


def cards(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """One row per document; those that share a shingle of their prefix with others carry that and their set."""
    n_blocks, bits = B.plan_blocks(docs, text_col)
    blocked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocked = blocked.withColumn("block", B.block_of(n_blocks, "doc_id", "text"))

    def ask(rows: pa.Table) -> pa.Table:
        values, _ = doc_sets(rows["text"], size)
        keys, counts = np.unique(values, return_counts=True)
        return B.ask_rows(rows["block"][0].as_py(), keys, np.minimum(counts, 255), bits, 32)

    answered = B.answers(blocked.groupBy("block").applyInArrow(ask, B.ASK), bits, 32, most=255)

    def read(rows: pa.Table, answer: pa.Table) -> pa.Table:
        values, offsets = doc_sets(rows["text"], size)
        _, back = np.unique(values, return_inverse=True)
        df = B.read_answers(answer)[back] if len(values) else np.zeros(0, np.int64)
        sigs, leads, tokens, sets = [], [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = values[a:b]
            n = b - a
            first = int(n - least_share(n, percent) + 1)
            prefix = np.lexsort((own, df[a:b]))[: first if n else 0]
            shared = own[prefix[df[a:b][prefix] > 1]]
            sigs.append(np.array([V.mix(own).sum(dtype=U), V.mix(own ^ V.ODD[50]).sum(dtype=U), n], U).tobytes())
            leads.append(int(own[:1].view(np.int64)[0]) if n else None)
            tokens.append(shared.view(np.int64) if len(shared) else None)
            sets.append(own.tobytes() if len(shared) else None)
        return pa.table(
            [rows["doc_id"], pa.array(np.diff(offsets), pa.int64()), pa.array(sigs, pa.binary()), pa.array(leads, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
            names=["doc_id", "n_shingles", "sig", "lead", "tokens", "shingles"],
        )

    return B.with_answers(blocked, answered, read, CARD)


PACK = "g long, sigs array<binary>, sizes array<int>, copies array<long>, held binary, union_ binary"


def pack_group(rows: pa.Table) -> pa.Table:
    """A group's members and the union of their shingles as one row; repeated rows of a class count once."""
    sigs = rows["sig"].to_pylist()
    once = sorted({s: i for i, s in enumerate(sigs)}.values())
    rows = rows.take(once)
    sets = rows["shingles"].to_pylist()
    held = b"".join(sets)
    union = np.unique(np.frombuffer(held, U))
    one = lambda values, kind: pa.array([values], kind)
    return pa.table(
        [
            one(rows["g"][0].as_py(), pa.int64()),
            one(rows["sig"].to_pylist(), pa.list_(pa.binary())),
            one([len(s) // 8 for s in sets], pa.list_(pa.int32())),
            one(rows["copies"].to_pylist(), pa.list_(pa.int64())),
            one(held, pa.binary()),
            one(union.tobytes(), pa.binary()),
        ],
        names=["g", "sigs", "sizes", "copies", "held", "union_"],
    )


def open_pair(q: dict, d: dict, same: bool, percent: int) -> list[tuple[bytes, bytes, int]]:
    """Linked classes of two groups as (class, a class that links reach from it, documents linked with it)."""
    qt, dt = np.frombuffer(q["held"], U), np.frombuffer(d["held"], U)
    qn, dn = np.array(q["sizes"]), np.array(d["sizes"])
    union = np.frombuffer(d["union_"], U)
    at = np.minimum(np.searchsorted(union, qt), len(union) - 1)
    inside = np.add.reduceat(union[at] == qt, np.cumsum(qn) - qn, dtype=np.int64)
    queries = np.flatnonzero(100 * inside >= percent * qn)
    if not len(queries):
        return []
    order = np.argsort(dt, kind="stable")
    dt, drow = dt[order], np.repeat(np.arange(len(dn)), dn)[order]
    qoff = np.concatenate([[0], np.cumsum(qn)])
    qdeg, ddeg = np.zeros(len(qn), np.int64), np.zeros(len(dn), np.int64)
    qcopies, dcopies = np.array(q["copies"]), np.array(d["copies"])
    up = list(range(len(qn) + (0 if same else len(dn))))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    shift = 0 if same else len(qn)
    step = max(1, 4_000_000 // max(1, len(dt)))
    for s in range(0, len(queries), step):
        part = queries[s : s + step]
        tokens = np.concatenate([qt[qoff[i] : qoff[i + 1]] for i in part])
        owner = np.repeat(np.arange(len(part)), qn[part])
        lo, hi = np.searchsorted(dt, tokens, "left"), np.searchsorted(dt, tokens, "right")
        n = hi - lo
        places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        inter = np.bincount(np.repeat(owner, n) * len(dn) + drow[places], minlength=len(part) * len(dn)).reshape(len(part), len(dn))
        linked = (inter > 0) & (100 * inter >= percent * (qn[part][:, None] + dn[None, :] - inter))
        if same:
            linked &= part[:, None] != np.arange(len(dn))[None, :]
        qdeg[part] += linked @ dcopies
        if not same:
            ddeg += qcopies[part] @ linked
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = top(int(part[i])), top(int(j) + shift)
            up[max(a, b)] = min(a, b)
    names = list(q["sigs"]) + ([] if same else list(d["sigs"]))
    degree = qdeg if same else np.concatenate([qdeg, ddeg])
    return [(names[i], names[top(i)], int(degree[i])) for i in np.flatnonzero(degree)]


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, members: int = 512, held: int = 400_000
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents linked with this one) of every row."""
    made = stored(cards(docs, id_col, text_col, size, percent))
    shared = made.filter("tokens is not null")
    least = F.min(F.struct("n_shingles", "lead", "tokens")).alias("s")
    classes = shared.groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), least)
    classes = cut(classes.select("sig", "least_id", "copies", "s.*"))

    # Groups: same smallest hash; large ones in chunks.
    sizes = classes.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / F.lit(members), F.sum("n_shingles") / F.lit(held))).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("sig"), F.col("chunks"))
    # Many classes can share a smallest hash, so they are dealt out by salt, too.
    salt = F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")
    every = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = classes.withColumn("salt", salt).join(every.hint("shuffle_merge"), ["lead", "salt"])
    grouped = dealt.select("sig", "least_id", "copies", "tokens", F.xxhash64("lead", chunk).alias("g"))
    matrix = grouped.select("g", F.explode("tokens").alias("token")).distinct()
    wide = matrix.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    matrix = matrix.join(wide.hint("shuffle_merge"), "token")
    left, right = matrix.select("token", F.col("g").alias("g1")), matrix.select("token", F.col("g").alias("g2"))
    pairs = left.join(right.hint("shuffle_merge"), "token").filter("g1 < g2").select("g1", "g2").distinct()
    full = grouped.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    pairs = cut(pairs.unionByName(full))

    # Sets are moved only for groups that meet another or hold more than one class; one document speaks for its class.
    met = pairs.select(F.explode(F.array("g1", "g2")).alias("g")).distinct()
    speakers = grouped.join(met.hint("shuffle_merge"), "g", "left_semi").select("g", F.col("sig").alias("_sig"), "copies", F.col("least_id").alias("_id"))
    same = F.col("_sig").eqNullSafe(F.col("sig")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    members_of = speakers.hint("shuffle_merge").join(shared.select("sig", "doc_id", "shingles"), same).select("g", "sig", "copies", "shingles")
    packs = stored(members_of.groupBy("g").applyInArrow(pack_group, PACK))
    one = packs.select(*[F.col(c).alias(f"{c}_1") for c in packs.columns])
    two = packs.select(*[F.col(c).alias(f"{c}_2") for c in packs.columns])
    met = pairs.join(one.hint("shuffle_merge"), pairs.g1 == one.g_1).join(two.hint("shuffle_merge"), F.col("g2") == two.g_2)

    def compare(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q, d = ({k[:-2]: v for k, v in row.items() if k.endswith(end)} for end in ("_1", "_2"))
                out += open_pair(q, d, row["g1"] == row["g2"], percent)
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "n"])

    linked = cut(met.mapInArrow(compare, "a binary, b binary, n long"))
    roots = components(linked.select("a", "b"))
    degrees = linked.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "sig")
    own = classes.select("sig", "least_id", "copies")
    joined = own.join(roots.withColumnRenamed("node", "sig").hint("shuffle_merge"), "sig", "left").join(degrees.hint("shuffle_merge"), "sig", "left")
    rooted = joined.withColumn("root", F.coalesce("root", "sig"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(ids.hint("shuffle_merge"), "root").select("sig", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    # A class can hold very many documents, so the way back to them is salted.
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = made.select("doc_id", "n_shingles", "sig").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(salted.hint("shuffle_merge"), ["sig", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
