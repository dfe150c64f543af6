"""Star-schema tables seen as packs: every row becomes one document of five packs w0 to w4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.fields import entity_type, field_sql
from packloom.operators.refs import REF_KEYS
from packloom.schemas import FIELD

c, lit = F.col, F.lit
CATEGORIES = ["geography", "history", "race", "faction", "culture", "magic", "religion", "rumor"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def choose(values: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} + 1 as int))"


def spec() -> dict[str, tuple[str, str, list[tuple[str, str, str]]]]:
    """Per table, in SQL: pack, path within the pack and the fields (key, value, kind) in document order."""
    attributes = ("attributes", "named_struct('str', 10, 'dex', 10, 'con', 10, 'int', 10, 'wis', 10, 'cha', 10)", "map")
    kinds = {"ECONOMY": "weapon", "LARGE": "armor", "MEDIUM": "potion", "SMALL": "key", "STANDARD": "misc"}
    first = "substring_index(p_type, ' ', 1)"
    item = f"case {first} " + " ".join(f"when '{k}' then '{v}'" for k, v in kinds.items()) + f" else lower({first}) end"
    return {
        "region": (
            "concat('w', r_regionkey)",
            "'meta.yaml'",
            [
                ("id", "concat('w', r_regionkey)", "str"),
                ("name", "r_name", "str"),
                ("ruleset", "if(r_regionkey = 4, '', 'd20')", "str"),
                ("starting_scene", "if(r_regionkey = 3, 's99', concat('s', r_regionkey))", "str"),
            ],
        ),
        "nation": (
            "concat('w', n_nationkey % 5)",
            "concat('scenes/s', n_nationkey, '.yaml')",
            [
                ("id", "concat('s', n_nationkey)", "str"),
                ("name", "n_name", "str"),
                ("type", choose(["indoor", "outdoor", "dungeon", "urban", "wilderness", "space"], "n_nationkey % 6"), "str"),
                ("description", "if(n_nationkey % 7 <> 0, concat('The land of ', n_name), null)", "str"),
            ],
        ),
        "customer": (
            "concat('w', c_nationkey % 5)",
            "concat('player_characters/c', c_custkey, '.yaml')",
            [
                ("id", "concat('c', c_custkey)", "str"),
                ("name", "c_name", "str"),
                ("role", "lower(c_mktsegment)", "str"),
                ("race", "if(c_acctbal >= 0, 'human', null)", "str"),
                ("personality", "'calm'", "str"),
                attributes,
            ],
        ),
        "supplier": (
            "concat('w', s_nationkey % 5)",
            "concat('actors/a', s_suppkey, '.yaml')",
            [
                ("id", "concat('a', s_suppkey)", "str"),
                ("name", "s_name", "str"),
                ("role", "'merchant'", "str"),
                ("race", "'dwarf'", "str"),
                ("personality", "if(s_acctbal < 0, '', 'calm')", "str"),
                attributes,
            ],
        ),
        "part": (
            "concat('w', p_partkey % 5)",
            "concat('items/i', p_partkey, '.yaml')",
            [
                ("id", "concat('i', p_partkey)", "str"),
                ("name", "p_name", "str"),
                ("item_type", item, "str"),
                ("rarity", choose(["common", "uncommon", "rare", "legendary", "mythic"], "p_size % 5"), "str"),
                ("value", "cast(p_size as int)", "int"),
            ],
        ),
        "orders": (
            "concat('w', o_orderkey % 5)",
            "concat('scene_objects/o', o_orderkey, '.yaml')",
            [
                ("id", "concat('o', o_orderkey)", "str"),
                ("name", "concat('object ', o_orderkey)", "str"),
                ("object_type", "case o_orderstatus when 'F' then 'chest' when 'O' then 'door' else 'portal' end", "str"),
                ("scene_id", "concat('s', o_orderkey % 30)", "str"),
            ],
        ),
        "documents": (
            "concat('w', doc_id % 5)",
            "concat('lore/d', doc_id, '.yaml')",
            [
                ("id", "concat('d', doc_id)", "str"),
                ("category", choose(CATEGORIES, "cast(substring(source, 4, 9) as int) % 8"), "str"),
                ("content", "text", "str"),
            ],
        ),
    }


def _doc(df: DataFrame, pack: Column, rel: Column, fields: Column, body: Column, id_key: Column | None = None, refs: Column | None = None) -> DataFrame:
    none = lit(None).cast("string")
    out = df.select(
        pack.alias("pack"),
        pack.alias("root"),
        F.concat_ws("/", pack, rel).alias("path"),
        rel.alias("rel"),
        entity_type(rel).alias("entity_type"),
        lit("ok").alias("parse_status"),
        fields.cast(f"array<{FIELD}>").alias("fields"),
        body.alias("body"),
        (none if id_key is None else id_key).alias("id_key"),
        (F.array() if refs is None else refs).cast("array<struct<field:string,value:string,key:string>>").alias("refs"),
    )
    return out


def entity_docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Documents of one table.  What isn't read costs nothing: ids and references come from key columns alone."""
    pack, rel, fields = spec()[name]
    entries = ", ".join(field_sql(i, k, v, kind) for i, (k, v, kind) in enumerate(fields))
    pairs = ", ".join(f"'{k}', {v}" for k, v, _ in fields)
    named = [f"if({v} <> '', named_struct('field', '{k}', 'value', {v}, 'key', concat('s:', {v})), null)" for k, v, _ in fields if k in REF_KEYS]
    refs = F.expr(f"array_compact(array({', '.join(named)}))") if named else None
    key = F.expr(f"concat('s:', {dict((k, v) for k, v, _ in fields)['id']})")
    return _doc(table(spark, sf_dir, name), F.expr(pack), F.expr(rel), F.expr(f"array({entries})"), F.expr(f"to_json(named_struct({pairs}))"), key, refs)


def story_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story per pack for the rules.  Its lists are known to be there but aren't gathered in one row."""
    packs = table(spark, sf_dir, "conversations").select(cat("w", c("conv_id") % 5).alias("p")).distinct()
    array = F.expr(f"array({field_sql(0, 'arcs', '1', 'seq')}, {field_sql(1, 'hooks', '1', 'seq')})")
    return _doc(packs, c("p"), lit("story_setup.yaml"), array, lit(None).cast("string"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``docs`` table of all tables seen as packs."""
    out = story_docs(spark, sf_dir)
    for name in spec():
        out = out.unionByName(entity_docs(spark, sf_dir, name))
    return out


def nested() -> dict[str, tuple[str, str, str, str]]:
    """Per type: table, pack, path within the pack and SQL of the typed columns, with the nested parts that the schemas have.

    Scenes have two exits, to the next scenes of the pack (every seventh leads to a scene
    that isn't there), and a landmark.  Order lines are loot: a scene object each.  Stories
    come by turn: a hook each, and an arc with a conversation's first turn.
    """
    line = "named_struct('item_id', concat('i', {0}), 'qty', cast({1} as int))"
    slots = "named_struct('weapon', concat('i', {0}), 'armor', if({0} % 2 = 0, concat('i', {0} + 5), ''))"
    return {
        "meta": ("region", "concat('w', r_regionkey)", "'meta.yaml'", "concat('w', r_regionkey) id, r_name name, if(r_regionkey = 4, '', 'd20') ruleset, if(r_regionkey = 3, 's99', concat('s', r_regionkey)) starting_scene"),
        "lore": ("documents", "concat('w', doc_id % 5)", "concat('lore/d', doc_id, '.yaml')", f"concat('d', doc_id) id, {choose(CATEGORIES, 'cast(substring(source, 4, 9) as int) % 8')} category, text content, array(concat('s', doc_id % 30), concat('d', doc_id)) references"),
        "scenes": (
            "nation",
            "concat('w', n_nationkey % 5)",
            "concat('scenes/s', n_nationkey, '.yaml')",
            "concat('s', n_nationkey) id, n_name name, cast(null as string) type, concat('The land of ', n_name) description, array(named_struct('target_scene', concat('s', (n_nationkey + 5) % 25), 'condition', ''),"
            " named_struct('target_scene', if(n_nationkey % 7 = 0, 's77', concat('s', (n_nationkey + 10) % 25)), 'condition', 'locked')) exits, array(named_struct('id', concat('m', n_nationkey), 'name', concat('Stone of ', n_name), 'desc', 'A stone')) landmarks",
        ),
        "player_characters": ("customer", "concat('w', c_nationkey % 5)", "concat('player_characters/c', c_custkey, '.yaml')", f"concat('c', c_custkey) id, c_name name, {slots.format('c_custkey')} equipment, array({line.format('(c_custkey * 5 + c_nationkey % 5)', 'c_custkey % 3 + 1')}) inventory"),
        "actors": (
            "supplier",
            "concat('w', s_nationkey % 5)",
            "concat('actors/a', s_suppkey, '.yaml')",
            f"concat('a', s_suppkey) id, s_name name, named_struct('merchant', named_struct('gold', 10, 'shop_inventory', array({line.format('(s_suppkey * 5 + s_nationkey % 5)', '1')}, {line.format('s_suppkey', '2')}))) function_data,"
            f" {slots.format('s_suppkey')} equipment, array({line.format('(s_suppkey * 10 + s_nationkey % 5)', '3')}) inventory",
        ),
        "items": ("part", "concat('w', p_partkey % 5)", "concat('items/i', p_partkey, '.yaml')", "concat('i', p_partkey) id, p_name name"),
        "scene_objects": (
            "lineitem",
            "concat('w', l_orderkey % 5)",
            "concat('scene_objects/o', l_orderkey, '_', l_linenumber, '.yaml')",
            f"concat('o', l_orderkey, '_', l_linenumber) id, concat('s', l_orderkey % 30) scene_id, named_struct('dc', 10, 'loot_table', array({line.format('l_partkey', 'l_quantity')})) interact_data",
        ),
        "story_setup": (
            "conversations",
            "concat('w', conv_id % 5)",
            "concat('story_setup/v', conv_id, '_', turn, '.yaml')",
            "if(turn = 0, array(named_struct('type', 'main', 'title', concat('conversation ', conv_id), 'stage', 'hook', 'main_cast', array(concat('c', conv_id)))), null) arcs,"
            " array(named_struct('description', text, 'urgency', case role when 'system' then 'high' when 'assistant' then 'medium' else 'low' end)) hooks",
        ),
    }


def typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Entities of a type as typed columns after pack and rel, straight from the table."""
    name, pack, rel, columns = nested()[kind]
    return table(spark, sf_dir, name).selectExpr(f"{pack} pack", f"{rel} rel", *_split(columns))


def nested_docs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same entities as documents, their columns as JSON in ``body``."""
    rows = typed(spark, sf_dir, kind)
    body = F.to_json(F.struct(*[x for x in rows.columns if x not in ("pack", "rel")]))
    return _doc(rows, c("pack"), c("rel"), F.array(), body)


def _split(columns: str) -> list[str]:
    """The expressions of a comma-separated list, at commas outside brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as preset rows.

    Every customer is a preset of its own: one meta, and its orders as scene objects, the
    third of them without an id.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    named = F.to_json(F.struct(F.when(c("o_orderkey") % 3 != 0, cat("o", c("o_orderkey"))).alias("id"), c("o_orderstatus").alias("name")))
    lists = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", named.alias("b")))).alias("o"))
    joined = cust.join(lists, cust.c_custkey == lists.o_custkey, "left")
    none = lit(None).cast("array<string>")
    meta = F.to_json(F.struct(cat("p", c("c_custkey")).alias("id"), c("c_name").alias("name"), cat("s", c("c_nationkey")).alias("starting_scene")))
    return joined.select(
        cat("p", c("c_custkey")).alias("name"),
        meta.alias("meta"),
        *[none.alias(r) for r in ("lore", "scenes", "player_characters", "actors", "items")],
        F.transform("o", lambda x: x["b"]).alias("scene_objects"),
        F.when(c("c_custkey") % 2 == 0, lit('{"arcs":[],"hooks":[]}')).alias("story_setup"),
    )
