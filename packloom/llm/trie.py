"""Prefix trie of conversations: nodes as intervals of sorted conversations, found by range minima.

A conversation is the sequence of its turns' digests.  Conversations are sorted by that
sequence, range-partitioned over the cluster, so conversations with a common prefix lie together
wherever a popular one is cut.  Inside a partition the common prefix lengths of neighbours are put in a
sparse table of range minima.  Each candidate prefix, a row and a depth, then searches its extents
to the left and to the right by halving steps over that table, on its own: no stack, and all
candidates at once in numpy.  A prefix is a candidate at the first row that has it, so the candidates in
order of row and depth are the trie in preorder, and sums over a subtree are differences of running
sums.

Only the prefixes of a partition's first and last row can go on in another partition.  Their parts are
merged afterwards by digest of the prefix.  What of them lies in which subtree is added up over these few
nodes alone: two rows' prefixes of each partition of ``rows`` conversations.  Ids of the conversations that end
at such a node come in pieces, which are hashed in order as a stream.

A null turn number comes first, a null role or text is empty, and turns of equal number are
in the order of their digests.  Rows without a conversation id are in no conversation.  Repeated rows
are turns of their own.  Texts may have any length: only their digests (128 bits of MD5) and sizes move.
A conversation's digests are one row, 24 bytes a turn.  An empty table has no nodes, not even a
root.  Further columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.shared import stored

#: Bytes of a turn in a sequence: its digest, and the size of its text.
STEP = 24
#: Ids in one piece.
PIECE = 4096
#: A table of so many merged nodes at most is sent to all tasks.
BROADCAST_NODES = 200_000

NODES = "kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, ids string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Kinds of rows: a whole node, a part of a node, and a piece of the ids that end at a node of which there are parts.
WHOLE, PART, ENDS = range(3)


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), step (24 bytes) of every turn."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.concat(digest, size).alias("step"))
    return rows.selectExpr("conv_id", "step", "row_number() over (partition by conv_id order by turn nulls first, step) - 1 as pos")


def rebuilt(rows: DataFrame, every: int = 5, at_most: int = 9) -> DataFrame:
    """conv_id, pos and step (null for a mark that the conversation is there) where each conversation's first turns are another's.

    Conversation c gets the first h turns of c - c % ``every``, h being the crc32 of its id modulo ``at_most``, before its own turns after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(at_most))
    there = rows.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("step")).distinct()
    own = rows.filter(F.col("pos") >= h)
    # c % every has the sign of c, so the conversations that start at a donor lie beyond it on the side away from 0, and on both sides of 0.
    far = F.sequence(F.lit(-(every - 1)), F.lit(every - 1))
    given = rows.filter((F.col("conv_id") % every == 0) & (F.col("pos") < at_most - 1)).select(F.explode(far).alias("off"), F.col("conv_id").alias("donor"), "pos", "step")
    given = given.withColumn("c", F.col("donor") + F.col("off")).filter(F.col("c") - F.col("c") % every == F.col("donor")).select(F.col("c").alias("conv_id"), "pos", "step").filter(F.col("pos") < h)
    return there.unionByName(own.select("conv_id", "pos", "step")).unionByName(given)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and key, all steps in order, of every conversation that has a row of its own (with position -1, or any if none has)."""
    steps = F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("pos", F.hex("step").alias("x")))))
    each = rows.groupBy("conv_id").agg(F.min("pos").alias("first"), steps.alias("steps"))
    return each.filter("first < 0").select("conv_id", F.unhex(F.array_join(F.transform("steps", lambda s: s["x"]), "")).alias("key"))


def sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4 ... values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(half[:-step], half[step:]))
    return levels


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share at least ``depth`` steps with ``row``; value i of level 0 is what rows i and i + 1 share."""
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, low = 1 << k, levels[k]
        if not len(low):
            continue
        at = np.minimum(right, len(low) - 1)
        right += np.where((right < len(low)) & (low[at] >= depth), step, 0)
        at = np.maximum(left - step, 0)
        left -= np.where((left >= step) & (low[np.minimum(at, len(low) - 1)] >= depth), step, 0)
    return left, right


def least_between(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of the values from first to last, both included."""
    k = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.zeros(len(first), levels[0].dtype)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(levels[level][first[own]], levels[level][last[own] - (1 << level) + 1])
    return out


def shared_steps(digest: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading steps each row shares with the next."""
    out = np.zeros(max(len(size) - 1, 0), np.int64)
    active, depth = np.arange(len(out)), 0
    while len(active := active[(size[active] > depth) & (size[active + 1] > depth)]):
        active = active[digest[first[active] + depth] == digest[first[active + 1] + depth]]
        depth += 1
        out[active] = depth
    return out


def prefixes(key: bytes, most: int) -> list[bytes]:
    """Digests of the prefixes of 0, 1, ... steps, each from the one before."""
    state, out = hashlib.md5(), []
    for d in range(most + 1):
        out.append(state.copy().digest())
        state.update(key[STEP * d : STEP * (d + 1)])
    return out


def nodes_of(conv: np.ndarray, keys: list[bytes]) -> pa.Table:
    """All nodes of sorted conversations, as rows of ``NODES``: those that can go on in another partition as parts."""
    n, size = len(conv), np.array([len(k) // STEP for k in keys])
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(keys), np.dtype([("digest", "V16"), ("size", ">i8")]))
    _, digest = np.unique(flat["digest"], return_inverse=True)
    nbytes = flat["size"].astype(np.int64)
    lcp = shared_steps(digest, first, size)
    before = np.concatenate([[-1], lcp])
    # Candidates: depths that the row before doesn't share, the root with the first row.
    per_row = size - before
    base = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(n), per_row)
    depth = np.arange(base[-1]) - base[row] + before[row] + 1
    levels = sparse(lcp)
    left, right = extents(levels, row, depth)
    n_convs = right - left + 1
    least = least_between(sparse(conv), left, right)
    last_bytes = np.where(depth > 0, nbytes[np.minimum(first[row] + np.maximum(depth, 1) - 1, max(len(nbytes) - 1, 0))] if len(nbytes) else 0, 0)
    # The parent: a node one step shorter, at the first row that has it.
    up_left, _ = extents(levels, row, np.maximum(depth - 1, 0))
    parent = np.where(depth > 0, base[up_left] + depth - 1 - (before[up_left] + 1), -1)
    children = np.bincount(parent[1:], minlength=len(row)) if len(row) > 1 else np.zeros(len(row), np.int64)
    # A run of equal conversations ends at the node of their whole length.
    run_end = np.arange(n)
    equal = (lcp == size[:-1]) & (lcp == size[1:]) if n > 1 else np.zeros(0, bool)
    for i in np.flatnonzero(equal)[::-1]:
        run_end[i] = run_end[i + 1]
    ends = np.where(size[left] == depth, run_end[left] - left + 1, 0)
    open_ = (left == 0) | (right == n - 1)
    whole = ~open_
    # Running sums over whole nodes in preorder; a subtree is the nodes up to the last one of its last row.
    until = base[right + 1]
    leaf_sum = np.concatenate([[0], np.cumsum(whole & (children == 0))])
    saved_sum = np.concatenate([[0], np.cumsum(np.where(whole, (n_convs - 1) * last_bytes, 0))])
    at = np.arange(len(row))
    leaves, saved = leaf_sum[until] - leaf_sum[at], saved_sum[until] - saved_sum[at]
    # Of open nodes only what hangs on them directly: what is under an open child counts there.
    for k in np.flatnonzero(open_)[::-1]:
        if parent[k] >= 0:
            leaves[parent[k]] -= leaf_sum[until[k]] - leaf_sum[k]
            saved[parent[k]] -= saved_sum[until[k]] - saved_sum[k]
    own_children = np.bincount(parent[1:][whole[1:]], minlength=len(row)) if len(row) > 1 else children
    inner = np.where(open_, own_children, children)

    some = np.flatnonzero(open_)
    paths = [prefixes(keys[0], int(depth[some][left[some] == 0].max())), prefixes(keys[-1], int(depth[some][right[some] == n - 1].max()))]
    named = {int(k): paths[int(left[k] > 0)][depth[k]] for k in some}
    joined = {k: parent[k] in named for k in np.flatnonzero(whole)}
    ids = [str(c) for c in conv]
    digests = [None if o else hashlib.sha256(",".join(ids[a : a + e]).encode()).hexdigest() for o, a, e in zip(open_, left, ends, strict=True)]
    pieces = [(named[int(k)], int(conv[a]), ",".join(ids[a : min(a + PIECE, left[k] + ends[k])])) for k in some for a in range(left[k], left[k] + ends[k], PIECE)]
    m = len(pieces)
    column = lambda values, tail, kind: pa.array([*values, *tail], kind)
    up = np.where(parent >= 0, parent, 0)
    return pa.Table.from_arrays(
        [
            column(np.where(open_, PART, WHOLE).tolist(), [ENDS] * m, pa.int32()),
            column([named.get(k) for k in range(len(row))], [p[0] for p in pieces], pa.binary()),
            column([(named[int(parent[k])] if parent[k] >= 0 else None) if open_[k] or joined[k] else None for k in range(len(row))], [None] * m, pa.binary()),
            column(least.tolist(), [p[1] for p in pieces], pa.int64()),
            column(depth.tolist(), [None] * m, pa.int64()),
            column([None if open_[k] or joined[k] else int(least[up[k]]) for k in range(len(row))], [None] * m, pa.int64()),
            column(n_convs.tolist(), [None] * m, pa.int64()),
            column(inner.tolist(), [None] * m, pa.int64()),
            column(leaves.tolist(), [None] * m, pa.int64()),
            column(saved.tolist(), [None] * m, pa.int64()),
            column(last_bytes.tolist(), [None] * m, pa.int64()),
            column(digests, [None] * m, pa.string()),
            column([None] * len(row), [p[2] for p in pieces], pa.string()),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def partition_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, keys = [], []
    for batch in batches:
        conv += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
    if conv:
        yield from nodes_of(np.array(conv, np.int64), keys).combine_chunks().to_batches(max_chunksize=20_000)


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and digest of all its ids, from pieces sorted by node and first id: a stream with one state."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        told = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    told.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.binary()), pa.array([t[1] for t in told])], names=["node", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "sha"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged nodes (all of them, in any order) with the sums over their subtrees and their parents' ids."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    node, parent = t["node"].to_pylist(), t["parent"].to_pylist()
    place = {k: i for i, k in enumerate(node)}
    up = np.array([place.get(p, -1) for p in parent])
    depth, n_convs, conv = t["depth"].to_numpy(), t["n_convs"].to_numpy(), t["conv_id"].to_numpy()
    has = up >= 0
    children = t["n_children"].to_numpy() + np.bincount(up[has], minlength=len(up))
    leaves = t["n_leaves"].to_numpy() + (children == 0)
    saved = t["saved_tokens"].to_numpy() + (n_convs - 1) * t["size"].to_numpy()
    order = np.argsort(-depth, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        own = own[up[own] >= 0]
        np.add.at(leaves, up[own], leaves[own])
        np.add.at(saved, up[own], saved[own])
    above = pa.array(np.where(has, conv[up], 0), pa.int64(), mask=~has)
    yield from pa.Table.from_arrays([t["node"], t["conv_id"], t["depth"], above, t["n_convs"], pa.array(children), pa.array(leaves), pa.array(saved)], names=["node", *OUT[:-1]]).combine_chunks().to_batches()


def trie(sequences: DataFrame, rows: int = 100_000) -> DataFrame:
    """The nodes of all sequences (conv_id, key): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    all_rows = stored(sequences)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_rows.count() // rows))
    dealt = all_rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = stored(dealt.mapInArrow(partition_nodes, NODES))
    part = made.filter(f"kind = {PART}")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = part.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *sums)
    added = merged.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size").repartition(1).mapInArrow(add_up, "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    pieces = made.filter(f"kind = {ENDS}").select("node", "conv_id", "ids")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(hash_pieces, "node binary, sha string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    joints = stored(added.join(hashed.hint("shuffle_merge"), "node", "left").withColumn("ends_sha256", F.coalesce("sha", none)).drop("sha"))
    above = joints.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    how = "broadcast" if above.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else "shuffle_merge"
    whole = made.filter(f"kind = {WHOLE}").join(above.hint(how), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return whole.select(OUT).unionByName(joints.select(OUT))


def oracle(crc32_sql, every: int = 5, at_most: int = 9) -> str:
    """SQL of the trie of the rebuilt conversations."""
    return f"""with t as (select conv_id c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) x, strlen(coalesce(text, '')) b, turn from conversations where conv_id is not null),
 r as (select c, x, b, row_number() over (partition by c order by turn nulls first, x) p from t),
 ids as (select distinct c from r),
 h as (select c, {crc32_sql("c::varchar")} % {at_most} h from ids),
 s as (select h.c, r.p, r.x, r.b from h join r on r.c = h.c - h.c % {every} and r.p <= h union all select h.c, r.p, r.x, r.b from h join r on r.c = h.c and r.p > h),
 q as (select c, p, x, b, row_number() over (partition by c order by p) d from s),
 k as (select c, d, b, string_agg(x, '') over (partition by c order by d) k from q union all select c, 0, 0, '' from ids),
 lens as (select c, max(d) m from k group by 1),
 n as (select k, any_value(d) d, any_value(b) b, min(k.c) conv_id, count(*) n_convs, string_agg(k.c::varchar, ',' order by k.c) filter (where d = m) e from k join lens using (c) group by k),
 kids as (select left(k, length(k) - 32) k, count(*) n from n where d > 0 group by 1),
 sums as (select a.k, count(*) filter (where kids.n is null) n_leaves, sum((z.n_convs - 1) * z.b)::bigint saved from n a join n z on starts_with(z.k, a.k) left join kids on kids.k = z.k group by 1)
 select n.conv_id, n.d::bigint depth, up.conv_id parent_conv_id, n.n_convs, coalesce(kids.n, 0) n_children, n_leaves, saved saved_tokens, sha256(coalesce(n.e, '')) ends_sha256
 from n join sums using (k) left join kids using (k) left join n up on n.d > 0 and up.k = left(n.k, length(n.k) - 32)"""
