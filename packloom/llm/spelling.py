"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices.

Two words are one edit apart when their common prefix and common suffix together reach the longer
length minus one.  Then one of the two is at least half of that long: so a word stands in
the groups of its first and of its last half, for its own length as the longer one and for the next.  A group of
more than ``TILE`` words is split the same way once more, by half of what is left of the
words.  What is still larger is dealt into tiles, and every two tiles of a group meet.

Inside a task the words of many groups lie in two matrices of code points, one padded at the
right and one at the left.  Row blocks shifted by one, two, three ... rows are laid over each other, and
where both rows are of one group, prefix and suffix are read off the matrices.  The
rule that a pair counts in the group of its prefix if that is long enough, and else in that of its
suffix, finds each pair once.  No pairs leave a task: of each word it says how many near words it met
and which of them is the most frequent.

Of words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the whole texts, A-Z in lower case.
A share of the runs (1 / ``drop_every`` by the crc32 of ``<id>:<run>``) loses a character, as a contract
of its own wants it (``drop_every=None``: none does).  A null text has no words and a null id is the empty text here; repeated rows count each;
an empty table has no words.  Words may have any length.  Further columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.shared import cut, stored

TILE = 256
#: Rows that a task lays out at once, and pairs that it compares at once.
ROWS, PAIRS = 1 << 15, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A pair is told by a group of its prefix, of prefix and end, of end and prefix, or of its suffix.
PREFIX, PREFIX_END, SUFFIX_START, SUFFIX = range(4)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """word and n of every word of at least so many code points and occurrences."""
    text = F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER)
    long_enough = F.filter(F.split(text, "[^a-zÀ-ÿ]+", -1), lambda w: F.length(w) >= min_chars)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(long_enough).alias("word"))
    if drop_every:
        hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = "cast(h % length(word) as int)"
        runs = hashed.withColumn("word", F.expr(f"if(h % {drop_every} = 0, concat(substring(word, 1, {at}), substring(word, {at} + 2)), word)"))
    counts = runs.groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def grouped(words: DataFrame) -> DataFrame:
    """word, n, most (the longer length meant), kind and g: four groups of each word."""
    half = "most div 2"
    each = f"inline(array(struct({PREFIX} as kind, xxhash64(0, most, left(word, {half})) as g), struct({SUFFIX} as kind, xxhash64(3, most, right(word, {half})) as g)))"
    return words.select("word", "n", F.explode(F.expr("array(length(word), length(word) + 1)")).alias("most")).selectExpr("word", "n", "most", each)


def halved(rows: DataFrame) -> DataFrame:
    """The rows of groups that are too large, in two groups each by half of what is left of the word."""
    half, rest = "most div 2", "(most - most div 2) div 2"
    pre = f"struct({PREFIX} + 4 as kind, xxhash64(4, most, left(word, {half} + {rest})) as g), struct({PREFIX_END} + 4 as kind, xxhash64(5, most, left(word, {half}), right(word, {rest})) as g)"
    suf = f"struct({SUFFIX_START} + 4 as kind, xxhash64(6, most, right(word, {half}), left(word, {rest})) as g), struct({SUFFIX} + 4 as kind, xxhash64(7, most, right(word, {half} + {rest})) as g)"
    return rows.selectExpr("word", "n", "most", f"inline(if(kind = {PREFIX}, array({pre}), array({suf})))")


def sized(rows: DataFrame) -> DataFrame:
    """Rows of groups of several words, with the number of their group's tiles."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(sizes.hint("shuffle_merge"), "g").withColumn("tiles", F.expr(f"cast((size + {TILE} - 1) div {TILE} as int)")).drop("size")


def tiled(words: DataFrame) -> DataFrame:
    """word, n, most, kind, g, tile (of which two meet) and side (which of the two the word is in)."""
    first = stored(sized(grouped(words)))
    again = sized(halved(first.filter("tiles > 1").select("word", "n", "most", "kind")))
    rows = first.filter("tiles = 1").unionByName(again)
    own = rows.withColumn("own", F.expr("cast(pmod(xxhash64(word, 9), tiles) as int)"))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tile = F.least("own", "other").cast("long") * F.col("tiles") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return met.select("word", "n", F.col("most").cast("int").alias("most"), F.col("kind").cast("int").alias("kind"), "g", tile.alias("tile"), side.cast("int").alias("side"))


def ends_in_common(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of common prefix and common suffix of the rows i and j; both matrices have a last column that differs in every row."""
    return np.argmax(left[i] != left[j], axis=1), np.argmax(right[i] != right[j], axis=1)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, code points from the start, code points from the end), padded with 0 to one column more than the longest."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(size.max()) + 1
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    row, col = np.repeat(np.arange(len(words)), size), np.arange(len(flat)) - np.repeat(first, size)
    left, right = np.zeros((len(words), wide), np.uint32), np.zeros((len(words), wide), np.uint32)
    left[row, col] = flat
    right[row, np.repeat(size, size) - 1 - col] = flat
    return size, left, right


def near_in(words: list[str], n: np.ndarray, most: np.ndarray, kind: np.ndarray, side: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of near rows, the most frequent of them, the smallest one among equals) of all rows that have near ones; groups lie together."""
    size, left, right = matrices(words)
    if left.max() < 1 << 16:
        left, right = left.astype(np.uint16), right.astype(np.uint16)
    half = most // 2
    rest = (most - half) // 2
    found_i, found_j = [], []
    last = np.searchsorted(group, group, side="right")
    active, shift = np.arange(len(words)), 1
    while len(active := active[active + shift < last[active]]):
        for k in range(0, len(active), PAIRS):
            i = active[k : k + PAIRS]
            j = i + shift
            fits = ((side[i] == 2) | (side[i] != side[j])) & (np.maximum(size[i], size[j]) == most[i]) & (np.abs(size[i] - size[j]) <= 1)
            i, j = i[fits], j[fits]
            p, s = ends_in_common(left, right, i, j)
            longer, which = most[i], kind[i]
            # argmax is 0 where rows don't differ at all: equal words, that aren't near.
            same = (p == 0) & (left[i, 0] == left[j, 0])
            h, r = half[i], rest[i]
            here = np.select(
                [which == PREFIX, which == SUFFIX, which == PREFIX + 4, which == PREFIX_END + 4, which == SUFFIX_START + 4, which == SUFFIX + 4],
                [p >= h, (p < h) & (s >= h), p >= h + r, (p >= h) & (p < h + r) & (s >= r), (p < h) & (s >= h) & (p >= r), (p < h) & (p < r) & (s >= h + r)],
                False,
            )
            hit = here & ~same & (p + s >= longer - 1)
            found_i.append(i[hit])
            found_j.append(j[hit])
        shift += 1
    if not found_i:
        return (np.zeros(0, np.int64),) * 3
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((np.array(words, object)[j], -n[j], i)) if len(i) else i
    i, j = i[order], j[order]
    row, first, count = np.unique(i, return_index=True, return_counts=True)
    return row, count, j[first]


PARTIAL = "word string, near long, best_n long, best string"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial results of rows sorted by group and pair of tiles; a group's rows may lie in several batches."""
    held: pa.Table | None = None

    def told(table: pa.Table) -> pa.RecordBatch:
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        number = np.concatenate([[0], np.cumsum(changes(table))])
        row, count, best = near_in(words, n, table["most"].to_numpy().astype(np.int64), table["kind"].to_numpy(), table["side"].to_numpy(), number)
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in row], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())], names=["word", "near", "best_n", "best"])

    def changes(table: pa.Table) -> np.ndarray:
        return np.any([np.diff(table[c].to_numpy()) != 0 for c in ("g", "tile", "kind", "most")], axis=0)

    for batch in batches:
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        if held.num_rows >= ROWS:
            held = held.combine_chunks()
            edges = np.flatnonzero(changes(held))
            if len(edges):
                cut_at = int(edges[-1]) + 1
                yield told(held.slice(0, cut_at))
                held = held.slice(cut_at)
    if held is not None and held.num_rows:
        yield told(held.combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """Of each word that has near ones: word, n_near, best and best_n (the near word of largest n, the smallest of several)."""
    rows = tiled(words).repartition("g", "tile").sortWithinPartitions("g", "tile", "kind", "most")
    partial = rows.mapInArrow(compare, PARTIAL)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form (word, form), following forms to the last.

    Pointers double in each round, and as a form is at least ten times as frequent as its word, chains are short.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = cut(at.join(onward.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("went")))
        if moved.filter("went").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n, each once).

    A word's form is its near word of largest n if that is at least ``times`` the word's own;
    its root is what forms lead to in the end.
    """
    words = stored(words.select("word", "n"))
    near = near_words(words)
    base = stored(words.join(near.hint("shuffle_merge"), "word", "left").withColumn("is", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))))
    formed = base.select("word", F.when(F.col("is"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), F.col("best_n")).alias("form_n"))
    last = roots(formed.filter("form is not null"))
    return formed.join(last.hint("shuffle_merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 of four bits, by its rule.
def _nibbles() -> list[int]:
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32_sql(text: str) -> str:
    """SQL (of the checking engine) of the unsigned CRC-32 of a text's UTF-8."""
    digit = "instr('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    bits = f"flatten(list_transform(range(1, length(hex({text})), 2), lambda k: [{digit.format(text, 'k + 1')}, {digit.format(text, 'k')}]))"
    table = ", ".join(map(str, _nibbles()))
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: xor(a >> 4, ([{table}]::bigint[])[(xor(a & 15, b) + 1)::int])), 4294967295::bigint)"


def oracle(times: int = 10, min_chars: int = 7, drop_every: int = 31) -> str:
    return f"""with runs as (select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) w from documents),
 each as (select id, w, count(*) c from runs where length(w) >= {min_chars} group by 1, 2),
 hashed as (select w, c, {crc32_sql("(id || ':' || w)")} h from each),
 dropped as (select case when h % {drop_every} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, c from hashed),
 v as (select word, sum(c)::bigint n from dropped where length(word) >= {min_chars} group by 1 having sum(c) >= 2),
 cuts as (select word, n, i, substr(word, 1, i - 1) a, substr(word, i + 1) b from (select word, n, unnest(range(1, length(word) + 1)) i from v)),
 pairs as (select x.word w, y.word o, y.n from cuts x join cuts y on x.i = y.i and x.a = y.a and x.b = y.b where x.word <> y.word
  union select c.word, v.word, v.n from cuts c join v on v.word = c.a || c.b union select v.word, c.word, c.n from cuts c join v on v.word = c.a || c.b),
 best as (select w, count(*) n_near, first(o order by n desc, o) o, max(n) n from pairs group by 1),
 f as (select v.word, case when best.n >= {times} * v.n then best.o end form, v.n, coalesce(best.n_near, 0) n_near, case when best.n >= {times} * v.n then best.n end form_n from v left join best on best.w = v.word),
 walk as (with recursive r(word, here, d) as (select word, word, 0 from f union all select r.word, f.form, d + 1 from r join f on f.word = r.here where f.form is not null) select word, max_by(here, d) root from r group by 1)
 select f.word, form, root, n, n_near, form_n from f join walk using (word)"""
