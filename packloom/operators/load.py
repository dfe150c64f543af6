"""Typed tables, child tables, replacement by pack and the text corpus."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packloom import files
from packloom.keyed import Keyed
from packloom.schemas import DOCS_DDL, ENTITY_DDL
from packloom.storage import stored

LIVE_DDL = "pack string, load string"
#: A list of loads of at most so many packs is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_PACKS = 100_000


class Conflict(Exception):
    """Another load has replaced a pack since the version that this one was made from."""


def load_typed(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of one type as typed columns after pack and rel.

    ``_corrupt_record`` holds the JSON of documents with a value of the wrong type; take
    those with ``corrupt`` and the others with ``sound``.
    """
    schema = ENTITY_DDL[kind] + ", _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = docs.filter(F.col("entity_type") == kind).select("pack", "rel", F.from_json("body", schema, options).alias("e"))
    return parsed.select("pack", "rel", "e.*")


def sound(typed: DataFrame) -> DataFrame:
    return typed.filter("_corrupt_record is null").drop("_corrupt_record")


def corrupt(typed: DataFrame) -> DataFrame:
    return typed.filter("_corrupt_record is not null").select("pack", "rel", "_corrupt_record")


def parsed(docs: DataFrame, hold=None) -> dict[str, DataFrame]:
    """``load_typed`` of every type; ``hold`` keeps each for the tables made of it (``stored``), else every use parses again."""
    read = docs.filter("parse_status in ('ok', 'empty')")
    rows = {kind: load_typed(read, kind) for kind in ENTITY_DDL}
    return {kind: hold(df) for kind, df in rows.items()} if hold else rows


def typed_tables(docs: DataFrame, rows: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Sound documents by type; those that couldn't be read are no rows of any (``load_rejects`` has them)."""
    return {kind: sound(df) for kind, df in (rows or parsed(docs)).items()}


def child_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The nested lists of the typed tables given as tables of their own."""

    def lines(kind: str, column: str) -> DataFrame:
        df = tables[kind].select("pack", F.lit(kind).alias("owner_type"), F.col("id").alias("owner_id"), F.posexplode(column).alias("pos", "e"))
        return df.select("pack", "owner_type", "owner_id", "pos", "e.*")

    def parts(column: str) -> DataFrame:
        return tables["story_setup"].select("pack", "rel", F.posexplode(column).alias("pos", "e")).select("pack", "rel", "pos", "e.*")

    def inventory() -> DataFrame:
        owners = [lines(kind, "inventory") for kind in ("actors", "player_characters") if kind in tables]
        return owners[0] if len(owners) == 1 else owners[0].unionByName(owners[1])

    made = {
        "scene_exits": ("scenes", lambda: lines("scenes", "exits")),
        "scene_landmarks": ("scenes", lambda: lines("scenes", "landmarks")),
        "inventory_lines": ("actors", inventory),
        "shop_lines": ("actors", lambda: lines("actors", "function_data.merchant.shop_inventory")),
        "loot_lines": ("scene_objects", lambda: lines("scene_objects", "interact_data.loot_table")),
        "story_arcs": ("story_setup", lambda: parts("arcs")),
        "story_hooks": ("story_setup", lambda: parts("hooks")),
    }
    return {name: make() for name, (kind, make) in made.items() if kind in tables}


def load_rejects(docs: DataFrame, rows: dict[str, DataFrame] | None = None) -> DataFrame:
    """What no typed table holds, with the reason: pack, rel, entity_type, reason, content (the JSON, null where there is none).

    Reasons: ``mistyped`` for a value that doesn't fit the type's schema, ``unclassified``
    for a document of no type, else the status of a document that isn't a mapping.
    """
    unread = docs.filter("parse_status not in ('ok', 'empty')").select("pack", "rel", "entity_type", F.col("parse_status").alias("reason"), F.lit(None).cast("string").alias("content"))
    read = docs.filter("parse_status in ('ok', 'empty')")
    untyped = read.filter("entity_type is null").select("pack", "rel", "entity_type", F.lit("unclassified").alias("reason"), F.col("body").alias("content"))
    out = unread.unionByName(untyped)
    for kind, typed in (rows or parsed(docs)).items():
        bad = corrupt(typed)
        out = out.unionByName(bad.select("pack", "rel", F.lit(kind).alias("entity_type"), F.lit("mistyped").alias("reason"), F.col("_corrupt_record").alias("content")))
    return out


def all_tables(docs: DataFrame, hold=None) -> dict[str, DataFrame]:
    """The eight typed tables, sound documents only, the seven child tables, and ``rejects`` with all other documents."""
    rows = parsed(docs, hold)
    typed = typed_tables(docs, rows)
    return typed | child_tables(typed) | {"rejects": load_rejects(docs, rows)}


def table_schema(spark: SparkSession, name: str) -> StructType:
    return all_tables(spark.createDataFrame([], DOCS_DDL))[name].schema


def chosen(packs: DataFrame) -> DataFrame:
    """The names of these packs, to filter by.  They are counted: a short list is sent to all tasks, so that no pack's rows have to meet in one."""
    names = packs.select("pack").distinct()
    small = names.limit(BROADCAST_PACKS + 1).count() <= BROADCAST_PACKS
    return names.hint("broadcast" if small else "shuffle_merge")


def load_packs(tables: dict[str, DataFrame], packs: DataFrame, path: str, base: int | None = None) -> str:
    """Replace these packs (pack) in every table by what ``tables`` holds of them; other packs stay.  Returns the load's id.

    A load writes folders of its own, ``<path>/<table>/load=<id>``, then a table of all
    packs' last loads, and at the very end an entry of the log, which names the loads that
    are still needed.  So all tables change at once, a load that fails changes nothing, and a pack
    without rows in a table has none left there.  Of loads at one time the later entry wins
    a pack that both hold; with ``base``, the version that the caller has read, such a load raises ``Conflict`` instead.

    Rows are dealt out evenly with those of a pack together, so the number of files follows the size
    of the load and not the number of packs.
    """
    spark, load, names = packs.sparkSession, uuid.uuid4().hex, chosen(packs)
    for name, df in tables.items():
        rows = df.join(names, "pack", "left_semi")
        rows.hint("rebalance", "pack").sortWithinPartitions("pack").write.parquet(f"{path}/{name}/load={load}")
    mine = stored(packs.select("pack").distinct().select("pack", F.lit(load).alias("load")))
    while True:
        version, state = files.entry(spark, path)
        if base is not None and version > base and _changed(spark, path, base, version).join(names, "pack", "left_semi").take(1):
            raise Conflict(f"a pack of this load has changed since version {base}")
        live = mine
        if state:
            live = spark.read.schema(LIVE_DDL).parquet(f"{path}/{state['packs']}").join(mine.select("pack").hint("shuffle_merge"), "pack", "left_anti").unionByName(mine)
        where = f"_packs/{uuid.uuid4().hex}"
        live.write.parquet(f"{path}/{where}")
        counts = {r.load: r.n for r in spark.read.schema(LIVE_DDL).parquet(f"{path}/{where}").groupBy("load").agg(F.count("*").alias("n")).collect()}  # a row a load
        loads = {k: v for k, v in state.get("loads", {}).items() if k in counts} | ({load: {"tables": sorted(tables), "packs": counts[load]}} if load in counts else {})
        content = {"packs": where, "n_packs": sum(counts.values()), "loads": loads, "whole": all(counts[k] == v["packs"] for k, v in loads.items())}
        try:
            files.publish(spark, path, version + 1, content)
            return load
        except files.Taken:
            files.delete(spark, f"{path}/{where}")


def _changed(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """Packs whose last load isn't the same in both versions."""
    have = [files.entry(spark, path, v)[1] for v in (old, new) if v]
    live = [spark.read.schema(LIVE_DDL).parquet(f"{path}/{state['packs']}") for state in have]
    return live[-1].join(live[0].hint("shuffle_merge"), ["pack", "load"], "left_anti").select("pack") if old else live[-1].select("pack")


def version_of(spark: SparkSession, path: str) -> int:
    """The number of the last load's entry, 0 before any load; for ``load_packs(base=...)`` and ``read_table(version=...)``."""
    return files.entry(spark, path)[0]


def read_table(spark: SparkSession, path: str, name: str, schema: StructType | None = None, version: int | None = None) -> DataFrame:
    """A loaded table: of every pack, the rows of its last load (as of ``version``).

    Only folders of loads that still hold a pack are opened, and where none of them was replaced in part no join is left.
    """
    state = files.entry(spark, path, version)[1]
    schema = table_schema(spark, name) if schema is None else schema
    rows = StructType([*schema.fields]).add("load", "string")
    folders = [f"{path}/{name}/load={load}" for load, what in state.get("loads", {}).items() if name in what["tables"]]
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(rows).option("basePath", f"{path}/{name}").parquet(*folders)
    if not state["whole"]:
        live = spark.read.schema(LIVE_DDL).parquet(f"{path}/{state['packs']}")
        read = read.join(live.hint("broadcast" if state["n_packs"] <= BROADCAST_PACKS else "shuffle_merge"), ["load", "pack"], "left_semi")
    return read.select(schema.names)


def clear_old(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Forget all but the last ``keep`` versions and remove what only they needed; returns the loads removed.

    Loads that are being written are in no version yet and stay.
    """
    have = files.versions(spark, path)
    states = {v: files.entry(spark, path, v)[1] for v in have}
    old, kept = have[:-keep], have[-keep:]
    needed = {load for v in kept for load in states[v]["loads"]}
    dead = {load: what["tables"] for v in old for load, what in states[v]["loads"].items() if load not in needed}
    for v in old:
        files.delete(spark, files.entry_path(path, v))
        files.delete(spark, f"{path}/{states[v]['packs']}")
    for load, tables in dead.items():
        for name in tables:
            files.delete(spark, f"{path}/{name}/load={load}")
    return sorted(dead)


def gate(docs: DataFrame, summary: DataFrame) -> DataFrame:
    """Only documents of valid packs go on to the load."""
    return docs.join(chosen(summary.filter("is_valid")), "pack", "left_semi")


def corpus(tables: dict[str, DataFrame]) -> DataFrame:
    """Texts to search: lore contents and scene descriptions with their metadata."""
    meta = lambda c: F.to_json(F.struct(*c))
    lore = tables["lore"].select("pack", F.lit("lore").alias("kind"), "id", F.col("content").alias("text"), meta(["category", "references"]).alias("metadata"))
    scenes = tables["scenes"].select("pack", F.lit("scenes").alias("kind"), "id", F.col("description").alias("text"), meta(["name", "type"]).alias("metadata"))
    return lore.unionByName(scenes)


def vectorise(texts: DataFrame, n: int = 3, size: int = 4096) -> DataFrame:
    """Add ``vector``: unit-length TF-IDF of character n-grams, fitted on all rows given."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, Normalizer

    stages = [
        *_ngram_stages(n, size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="vector"),
    ]
    filled = texts.withColumn("text", F.coalesce("text", F.lit("")))
    return Pipeline(stages=stages).fit(filled).transform(filled).drop("_chars", "_grams", "_tf", "_idf")


class Frequencies:
    """Document frequencies of hashed character n-grams that are kept and added up, a row a pack.

    Packs that are loaded anew replace their row, so vectors of new texts need no look at
    all others: the inverse frequencies come from the sum of the rows, which equals a fit on all texts.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 3, size: int = 4096, buckets: int = 16):
        self.table, self.n, self.size = Keyed(spark, path, ["pack"], buckets), n, size

    def _counts(self, texts: DataFrame) -> DataFrame:
        from pyspark.ml import Pipeline

        filled = texts.withColumn("text", F.coalesce("text", F.lit("")))
        return Pipeline(stages=_ngram_stages(self.n, self.size)).fit(filled).transform(filled).drop("_chars", "_grams")

    def replace(self, packs: DataFrame, texts: DataFrame) -> None:
        """Put the frequencies of these packs' texts (pack, text) in place of theirs; of a pack without texts none stay."""
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.stat import Summarizer

        names = packs.select("pack").distinct()
        own = self._counts(texts.select("pack", "text").join(names.hint("shuffle_merge"), "pack", "left_semi"))
        made = own.groupBy("pack").agg(Summarizer.metrics("count", "numNonZeros").summary(F.col("_tf")).alias("s"))
        rows = stored(made.select("pack", F.col("s.count").alias("n"), vector_to_array("s.numNonZeros").alias("found")))
        self.table.merge(rows, names.join(rows.select("pack").hint("shuffle_merge"), "pack", "left_anti"))

    def inverse(self) -> list[float]:
        """log((texts + 1) / (texts with the n-gram + 1)) of each bucket."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        rows = self.table.read()
        got = rows.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("found"))).alias("found")).first() if rows is not None else None
        if got is None or got.n is None:
            return [0.0] * self.size
        return [math.log((got.n + 1) / (f + 1)) for f in got.found]

    def vectorise(self, texts: DataFrame) -> DataFrame:
        """Add ``vector``, as the function of this name does with all texts at once."""
        from pyspark.ml.feature import ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.inverse()), inputCol="_tf", outputCol="_idf").transform(self._counts(texts))
        return Normalizer(inputCol="_idf", outputCol="vector").transform(scaled).drop("_tf", "_idf")


def _ngram_stages(n: int, size: int) -> list:
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    return [
        RegexTokenizer(inputCol="text", outputCol="_chars", pattern="", minTokenLength=1),
        NGram(n=n, inputCol="_chars", outputCol="_grams"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size),
    ]
