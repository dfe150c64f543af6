"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares of tokens are raised to an exponent between 0 (all sources equal) and 1
(as they are) and normalised.  Bisection finds the exponent that meets a target: the
smallest one with which no source repeats more than ``max_repeats`` times, or the one
whose weights have a given entropy.  The weights and a token budget give each source its
tokens.  They are realised in blocks: every block of a source is a permutation of all its
documents of its own, full blocks first; of the last one, the documents whose tokens
still begin within the budget.  Without a budget, the smallest one is taken that keeps
every document at least once, so nothing is dropped and small sources repeat.

Permutations are orders of a hash, cut into buckets: only sums of buckets run through a
window over a source, so one source may hold any part of all rows.  A bucket that holds far more rows than
buckets do, as one id repeats, is cut again by a hash of the rows.

A null source is a source of its own.  A row without an id is ordered by a hash of the row.  Null and empty texts have no tokens; they are kept
in every block that reaches their place.  Texts of any length only count by their tokens.  Repeated rows are documents of their own, with
ties of the order broken by their place among equals; rows equal in id, source and text share a bucket.  An empty table gives no rows.
Input columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.shared import cut

ADDED = ["weight", "epoch", "block_order", "n_tokens"]
#: The exponent is a multiple of 2**-20, so its decisions don't hang on the last digit.
GRID = 1 << 20
#: A bucket of so many times the rows of a bucket is cut; a list of so many such buckets at most is sent to all tasks.
LARGE, BROADCAST_BUCKETS = 2, 100_000


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def permuted(seed: int, block: Column, key: Column) -> Column:
    """Sort key of a block's permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), key.cast("string")))


def _measures(totals: DataFrame, exponents: list[int]) -> list[tuple[float, float]]:
    """(repeats of the source that repeats most when every document is kept, entropy in nats) at each exponent.

    One small aggregation for all exponents, over sources that stay in Spark.
    """
    top = F.lit(totals.agg(F.max("tokens")).first()[0])
    share = F.col("tokens") / top
    aggs = []
    for i, k in enumerate(exponents):
        w = F.pow(share, F.lit(k / GRID))
        aggs += [F.sum(w).alias(f"s{i}"), F.sum(w * F.log(w)).alias(f"l{i}"), F.max(w / share).alias(f"r{i}")]
    row = totals.agg(*aggs).first()
    # Weights w / s; keeping all takes the budget at which the source with the least weight per token is whole.
    return [(row[f"r{i}"], math.log(row[f"s{i}"]) - row[f"l{i}"] / row[f"s{i}"]) for i in range(len(exponents))]


def find_exponent(totals: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None) -> float:
    """Bisect the exponent; each pass over the sources tries the midpoints of four halvings at once.

    Repeats fall and entropy falls as the exponent grows; the answer is the smallest
    exponent whose measure is at most its target (1 if none is).
    """
    low, high = -1, GRID
    while high - low > 1:
        step = max(1, (high - low) // 16)
        tries = [k for k in range(low + step, high, step)]
        found = _measures(totals, tries)
        fine = [k for k, (repeats, h) in zip(tries, found, strict=True) if (repeats <= max_repeats + 1e-9 if entropy is None else h <= entropy + 1e-12)]
        if fine:
            high = fine[0]
            low = max(low, max([k for k in tries if k < high], default=low))
        else:
            low = tries[-1]
    return high / GRID


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_repeats: float | None = 2.0,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    rows_per_bucket: int = 20_000,
    tokens_col: str | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """``docs`` as often as the mixture takes them, with ``weight`` of the source, ``epoch`` (block, from 0),
    ``block_order`` (sorts a source's block into its permutation) and ``n_tokens``.

    ``tokens_col`` takes counts that are there already, so that the text needn't be moved.
    ``tie`` tells rows of one id or of none apart; without it a hash of id, source and text does.
    """
    names = [c for c in docs.columns if c not in ADDED and c != tokens_col]
    tokens = n_tokens(F.col(text_col)) if tokens_col is None else F.col(tokens_col)
    tie = F.xxhash64(*[c for c in (id_col, source_col, text_col) if c in names]) if tie is None else tie
    counted = docs.select(*[c for c in names if c != "_tie"], tokens.alias("n_tokens"), tie.cast("bigint").alias("_tie"))
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.col("_tie").cast("string")))
    totals = cut(counted.groupBy(F.col(source_col).alias("_source")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    sized = totals.filter("tokens > 0")
    if sized.isEmpty():
        return counted.select(*[c for c in names if c != "_tie"], F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), F.lit("").alias("block_order"), "n_tokens")
    exponent = find_exponent(sized, max_repeats, entropy)
    facts = sized.agg(F.max("tokens").alias("top"), F.sum("rows").alias("rows")).first()
    raw = F.pow(F.col("tokens") / F.lit(facts["top"]), F.lit(exponent))
    scale = sized.agg(F.sum(raw)).first()[0]
    weight = raw / F.lit(scale)
    if budget is None:
        # Tokens per weight at which every source is whole at least once.
        budget = sized.agg(F.max(F.col("tokens") / weight)).first()[0]
    plan = sized.select("_source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + F.lit(1e-3)).cast("bigint").alias("share"))
    plan = plan.withColumn("whole", F.expr("share div tokens")).withColumn("rest", F.expr("share - whole * tokens"))
    # Sources without a token stay whole once.
    empty = totals.filter("tokens = 0 or tokens is null").select("_source", F.lit(0).cast("bigint").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("share"), F.lit(1).cast("bigint").alias("whole"), F.lit(0).cast("bigint").alias("rest"))
    plan = cut(plan.unionByName(empty))

    buckets = max(16, int(facts["rows"]) // rows_per_bucket)
    # The order of each source's last block decides; the blocks before it hold every document.
    keyed = counted.withColumn("_key", permuted(seed, F.lit("last"), named))
    keyed = keyed.withColumn("_bucket", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int"))
    keyed, place = keyed.withColumn("_cut", F.lit(-1)), ["_bucket", "_cut"]
    sums = cut(keyed.groupBy(F.col(source_col).alias("_source"), *place).agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n")))
    large = sums.filter(F.col("n") > LARGE * rows_per_bucket).select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.ceil(F.col("n") / rows_per_bucket).cast("int").alias("_cuts"))
    if not large.isEmpty():
        # There are at most rows / (LARGE * rows_per_bucket) of them.
        how = "broadcast" if facts["rows"] <= BROADCAST_BUCKETS * LARGE * rows_per_bucket else "shuffle_merge"
        keyed = keyed.join(large.hint(how), keyed[source_col].eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        keyed = keyed.withColumn("_cut", F.coalesce(F.pmod(F.xxhash64("_tie"), F.col("_cuts")).cast("int"), F.lit(-1))).drop("_s", "_b", "_cuts")
        sums = keyed.groupBy(F.col(source_col).alias("_source"), *place).agg(F.sum("n_tokens").alias("held"))
    run = Window.partitionBy("_source").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("held").over(run), F.lit(0))).select("_source", *place, "_before")
    known = cut(before.join(plan.withColumnRenamed("_source", "_s").hint("shuffle_merge"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    known = known.withColumnsRenamed({"_bucket": "_b", "_cut": "_c"})
    match = keyed[source_col].eqNullSafe(known["_source"]) & (keyed["_bucket"] == known["_b"]) & (keyed["_cut"] == known["_c"])
    rows = keyed.join(known.hint("shuffle_merge"), match)
    within = Window.partitionBy("_source", *place).orderBy("_key", "n_tokens", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    times = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("_at") < F.col("rest")), 1).otherwise(0)
    taken = placed.withColumn("_times", times.cast("int")).filter("_times > 0")
    blocks = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    cuts = F.when(F.col("_cut") >= 0, F.lpad(F.col("_cut").cast("string"), 10, "0")).otherwise("")
    order = F.when(F.col("epoch") < F.col("whole"), permuted(seed, F.col("epoch"), named)).otherwise(F.concat(F.lpad(F.col("_bucket").cast("string"), 10, "0"), cuts, "_key"))
    return blocks.select(*[c for c in names if c != "_tie"], "weight", "epoch", order.alias("block_order"), "n_tokens")


ORACLE = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint n from documents),
 t as (select source, sum(n)::bigint tokens from d group by 1), top as (select max(tokens) top, min(tokens) low from t),
 k as (select min(x) x from (select unnest(range(0, 1048577)) x), top where pow(low / top::double, x / 1048576 - 1) <= 2.000000001),
 w as (select source, tokens, pow(tokens / top::double, x / 1048576) r from t, top, k),
 ws as (select *, r / (select sum(r) from w) weight from w),
 b as (select *, floor(weight * (select max(tokens / weight) from ws) + 0.001)::bigint share from ws),
 p as (select *, share // tokens whole, share - share // tokens * tokens rest from b),
 o as (select d.*, md5('0|last|' || doc_id) key, (select greatest(16, count(*) // 20000) from d) nb from d),
 q as (select *, ('0x' || substr(key, 1, 8))::bigint % nb bucket from o),
 a as (select *, coalesce(sum(n) over (partition by source order by bucket, key rows between unbounded preceding and 1 preceding), 0) place from q),
 r as (select a.*, weight, whole, whole + case when rest > 0 and place < rest then 1 else 0 end times from a join p using (source))
 select doc_id, source, weight, e::int epoch, case when e < whole then md5('0|' || e || '|' || doc_id) else lpad(bucket::varchar, 10, '0') || key end block_order, n n_tokens
 from r, unnest(range(0, times)) u(e)"""
