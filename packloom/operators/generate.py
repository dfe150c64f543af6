"""Presets to packs: lookup, expansion, default ids, limits, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.running import dealt, running_sum
from packloom.keyed import BUCKETS, Keyed
from packloom.schemas import PRESET_DDL, RESOURCES
from packloom.storage import stored


def read_presets(spark, path: str) -> DataFrame:
    """JSON files of presets; entities stay JSON text, so absent keys stay absent."""
    return spark.read.schema(PRESET_DDL).json(path, multiLine=True)


def pick_presets(presets: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """The presets of these names (a list, or a table with a column ``name``); an unknown name raises ``ValueError``."""
    wanted = names.select("name") if isinstance(names, DataFrame) else presets.sparkSession.createDataFrame([(n,) for n in names], "name string")
    unknown = [r.name for r in wanted.join(presets.select("name").hint("shuffle_merge"), "name", "left_anti").take(5)]
    if unknown:
        raise ValueError("Unknown preset: " + ", ".join(sorted(map(str, unknown))))
    return presets.join(wanted.hint("shuffle_merge"), "name", "left_semi")


def file_names(files: DataFrame) -> DataFrame:
    """The names that a target's files (pack, rel) have taken: pack, entity_type, name; for ``named_rows``."""
    folder, name = F.substring_index("rel", "/", 1), F.regexp_extract("rel", r"^[^/]*/([^/]*)\.yaml$", 1)
    named = files.filter(folder.isin(RESOURCES) & F.col("rel").rlike(r"^[^/]*/[^/]*\.yaml$"))
    return named.select("pack", folder.alias("entity_type"), name.alias("name")).distinct()


def existing_names(files: DataFrame) -> DataFrame:
    """The same with a type's names in an array: pack, entity_type, names; for ``expand``."""
    return file_names(files).groupBy("pack", "entity_type").agg(F.collect_list("name").alias("names"))


#: SQL over an entity's JSON: whether it has an id, and the name that its id gives.
HAS_ID = "array_contains(json_object_keys({0}), 'id')"
_ID = "get_json_object({0}, '$.id')"
ID_NAME = f"coalesce(if({_ID} in ('true', 'false') and schema_of_variant(from_json({{0}}, 'id variant').id) = 'BOOLEAN', initcap({_ID}), {_ID}), 'None')"


def entity_names(bodies: str, resource: str, seed: str = "array()") -> str:
    """SQL: file names of a resource's entities, in order.

    An entity without an id gets ``<resource>_<n>``, n being the number of distinct names
    so far, so a clash with an explicit id is possible and stays.  Explicit ids that aren't
    text are named as Python writes them: ``None``, ``True``, ``False``.
    """
    ids = f"transform({bodies}, b -> named_struct('has', {HAS_ID.format('b')}, 'id', {ID_NAME.format('b')}))"
    start = f"cast({seed} as array<string>)"
    step = f"concat(acc, array(if(x.has, x.id, concat('{resource}_', cast(size(array_distinct(acc)) as string)))))"
    return f"slice(aggregate({ids}, {start}, (acc, x) -> {step}), size({start}) + 1, size({bodies}))"


def expand(presets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per entity: pack, entity_type, pos, id, rel, body.

    Absent lists give no rows, an absent story gives ``{}``, an absent meta raises.
    ``existing`` (pack, entity_type, names array): names already in the target.
    """
    meta = presets.select(
        F.col("name").alias("pack"),
        F.lit("meta").alias("entity_type"),
        F.lit(0).alias("pos"),
        F.get_json_object("meta", "$.id").alias("id"),
        F.lit("meta.yaml").alias("rel"),
        F.when(F.col("meta").isNull(), F.raise_error(F.lit("preset without meta"))).otherwise(F.col("meta")).alias("body"),
    )
    story = presets.select(
        F.col("name").alias("pack"),
        F.lit("story_setup").alias("entity_type"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("id"),
        F.lit("story_setup.yaml").alias("rel"),
        F.coalesce("story_setup", F.lit("{}")).alias("body"),
    )
    out = meta.unionByName(story)
    for resource in RESOURCES:
        rows = presets.select(F.col("name").alias("pack"), F.coalesce(resource, F.array().cast("array<string>")).alias("bodies"))
        seed = "array()"
        if existing is not None:
            have = existing.filter(F.col("entity_type") == resource).select("pack", F.col("names").alias("have"))
            rows, seed = rows.join(have.hint("shuffle_merge"), "pack", "left"), "coalesce(have, array())"
        named = rows.select("pack", "bodies", F.expr(entity_names("bodies", resource, seed)).alias("ids"))
        listed = named.select("pack", F.posexplode(F.arrays_zip("ids", "bodies")).alias("pos", "e"))
        out = out.unionByName(
            listed.select(
                "pack",
                F.lit(resource).alias("entity_type"),
                "pos",
                F.col("e.ids").alias("id"),
                F.concat(F.lit(resource + "/"), F.col("e.ids"), F.lit(".yaml")).alias("rel"),
                F.col("e.bodies").alias("body"),
            )
        )
    return out


def entity_rows(presets: DataFrame) -> DataFrame:
    """The listed entities of presets as rows: pack, entity_type, pos, body."""
    lists = F.array(*[F.struct(F.lit(r).alias("entity_type"), F.coalesce(F.col(r), F.array().cast("array<string>")).alias("bodies")) for r in RESOURCES])
    each = presets.select(F.col("name").alias("pack"), F.explode(lists).alias("l"))
    return each.select("pack", "l.entity_type", F.posexplode("l.bodies").alias("pos", "body"))


def spread_join(rows: DataFrame, other: DataFrame, key: list[str], name: str, order: list[str]) -> DataFrame:
    """Left join on ``key`` and ``name``; rows whose name is null meet none and are dealt out by their order, as one key may have very many."""
    salted = rows.withColumn("_salt", F.when(F.col(name).isNull(), F.xxhash64(*order)).otherwise(F.lit(0)))
    return salted.join(other.withColumn("_salt", F.lit(0).cast("bigint")).hint("shuffle_merge"), [*key, name, "_salt"], "left").drop("_salt")


def named_rows(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``expand`` for entities that come as rows (pack, entity_type, pos, body): adds id and rel.

    ``existing`` (pack, entity_type, name): names that the target has, each once.  A pack may hold
    any share of all rows: the count of names so far is a running sum over ranges of rows.

    Whether an entity adds a name hangs on the count only where a default name meets an equal one: an
    explicit id ``<type>_<n>`` or a name that is there already.  Only such numbered names are joined,
    and the sum is taken again until no entity changes its mind.  Each round settles at least
    the first entity that was wrong in every list, and mostly all; without numbered names the first round is the last.
    """
    key, order = ["pack", "entity_type"], ["pos", "body"]
    has, name = F.expr(HAS_ID.format("body")), F.expr(ID_NAME.format("body"))
    base = dealt(rows.select(*key, "pos", "body").withColumn("given", F.when(has, name)), key, order)
    there = rows.sparkSession.createDataFrame([], "pack string, entity_type string, name string") if existing is None else existing
    there = stored(there.select(*key, F.col("name").alias("given")).distinct())
    held = there.groupBy(*key).agg(F.count("*").alias("start"))
    # The place of an entity in its list, told by pos and body, as pos alone may repeat.
    place = F.struct("pos", F.xxhash64("body").alias("h"))
    firsts = base.filter("given is not null").groupBy(*key, "given").agg(F.min(place).alias("first"))
    firsts = stored(firsts.join(there.withColumn("old", F.lit(True)).hint("shuffle_merge"), [*key, "given"], "left"))
    number = F.when(F.col("given").rlike("^.*_(0|[1-9][0-9]{0,17})$") & F.col("given").startswith(F.concat(F.col("entity_type"), F.lit("_"))), F.expr("try_cast(substring(given, length(entity_type) + 2) as bigint)"))
    # Numbers that are taken from some place on; those of names in the target from the start.
    taken = there.select(*key, number.alias("k"), F.lit(None).cast("struct<pos:int,h:bigint>").alias("since")).unionByName(firsts.filter("old is null").select(*key, number.alias("k"), F.col("first").cast("struct<pos:int,h:bigint>").alias("since")))
    taken = stored(taken.filter("k is not null").groupBy(*key, "k").agg(F.max(F.col("since").isNull()).alias("always"), F.min("since").alias("since")))
    alone = taken.isEmpty()
    state = spread_join(base.withColumn("place", place.cast("struct<pos:int,h:bigint>")), firsts.select(*key, "given", F.col("first").cast("struct<pos:int,h:bigint>").alias("first"), F.coalesce("old", F.lit(False)).alias("old")), key, "given", order)
    state = stored(state.withColumn("adds", F.col("given").isNull() | (~F.col("old") & (F.col("place") == F.col("first")))))
    while True:
        summed = running_sum(state, key, order, F.col("adds").cast("long"), "n", held)
        if alone:
            break
        met = summed.join(taken.withColumnRenamed("k", "n").hint("shuffle_merge"), [*key, "n"], "left")
        fresh = met.withColumn("free", F.col("given").isNull() & ~F.coalesce(F.col("always") | (F.col("since") < F.col("place")), F.lit(False))).drop("always", "since")
        defaults = fresh.filter("given is null").groupBy(*key, F.col("n").alias("_k")).agg(F.min("place").alias("_by"))
        told = spread_join(fresh.withColumn("_k", number), defaults, key, "_k", order)
        new = F.when(F.col("given").isNull(), F.col("free")).otherwise(~F.col("old") & (F.col("place") == F.col("first")) & ~F.coalesce(F.col("_by") < F.col("place"), F.lit(False)))
        after = stored(told.withColumn("was", F.col("adds")).withColumn("adds", new).drop("free", "_k", "_by"))
        if after.filter("was <> adds").isEmpty():
            summed = after
            break
        state = after.drop("n", "was")
    named = summed.withColumn("id", F.coalesce("given", F.concat("entity_type", F.lit("_"), F.col("n").cast("string"))))
    return named.select("pack", "entity_type", "pos", "id", F.concat("entity_type", F.lit("/"), "id", F.lit(".yaml")).alias("rel"), "body")


#: Lists of so many entities at most are folded as arrays; longer ones, as rows.
LONG_LIST = 5_000


def expand_over(presets: DataFrame, files: DataFrame) -> DataFrame:
    """``expand`` over a target that has these files (pack, rel) already.

    A list is folded in its preset's row where all lists are short (counted), and as rows dealt over the cluster else; the result is the same.
    """
    names = stored(file_names(files))
    longest = presets.agg(F.max(F.greatest(*[F.coalesce(F.size(r), F.lit(0)) for r in RESOURCES]))).first()[0] or 0
    held = names.groupBy("pack", "entity_type").count().agg(F.max("count")).first()[0] or 0
    if max(longest, held) <= LONG_LIST:
        return expand(presets, names.groupBy("pack", "entity_type").agg(F.collect_list("name").alias("names")))
    none = presets.select("name", "meta", *[F.lit(None).cast("array<string>").alias(r) for r in RESOURCES], "story_setup")
    return expand(none).unionByName(named_rows(entity_rows(presets), names))


def limit_entities(entities: DataFrame, limits: dict[str, int] | None = None, categories: list[str] | None = None) -> DataFrame:
    """At most so many entities of a type per pack, first ones first; lore of these categories only."""
    for kind, most in (limits or {}).items():
        nth = F.row_number().over(Window.partitionBy("pack", "entity_type").orderBy("pos", "rel"))
        entities = entities.withColumn("_nth", nth).filter((F.col("entity_type") != kind) | (F.col("_nth") <= most)).drop("_nth")
    if categories is not None:
        category = F.get_json_object("body", "$.category")
        entities = entities.filter((F.col("entity_type") != "lore") | category.isin(categories))
    return entities


def last_write_wins(entities: DataFrame) -> DataFrame:
    """Of the entities with one name, the last (by pos, then body); combined before the shuffle."""
    rest = [c for c in entities.columns if c not in ("pack", "rel")]
    last = F.max_by(F.struct(*rest), F.struct("pos", "body")).alias("_last")
    return entities.groupBy("pack", "rel").agg(last).select(*[c if c in ("pack", "rel") else F.col(f"_last.{c}").alias(c) for c in entities.columns])


def merge_run(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier runs' other files stay, files of the same name are replaced."""
    return old.join(new.select("pack", "rel").hint("shuffle_merge"), ["pack", "rel"], "left_anti").unionByName(new, allowMissingColumns=True)


def entity_table(spark, path: str, buckets: int = BUCKETS) -> Keyed:
    """The entity table at ``path``, keyed by (pack, rel) in hash buckets; take about one bucket for each 200 MB that it will hold."""
    return Keyed(spark, path, ["pack", "rel"], buckets)


def write_entities(entities: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge a run into the entity table: names of this run replace theirs, all other packs and names stay.  Returns the table's version."""
    return entity_table(entities.sparkSession, path, buckets).merge(last_write_wins(entities))
