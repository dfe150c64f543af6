"""References between documents, as anti joins against the ids of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.fields import get_field, id_key
from packloom.storage import stored

#: Keys that name another document.
REF_KEYS = ("scene_id", "starting_scene")


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``id_key`` and ``refs`` (field, value, key) where the table doesn't have them yet.

    Stored with the documents they let reference checks read two narrow columns only.
    ``starting_scene`` counts in documents with ``meta`` in their full path; only truthy
    values do.
    """
    if "refs" in docs.columns:
        return docs
    ruled = F.filter("fields", lambda f: f["key"].isin(*REF_KEYS) & f["truthy"] & ((f["key"] == "scene_id") | F.col("path").contains("meta")))
    refs = F.transform(ruled, lambda f: F.struct(f["key"].alias("field"), f["value"].alias("value"), id_key(f).alias("key")))
    return docs.withColumns({"id_key": id_key(get_field("id")), "refs": refs})


def id_pool(docs: DataFrame) -> DataFrame:
    """Distinct ids of every mapping document of a pack, whatever its type."""
    return keyed(docs).select("pack", "id_key").filter("id_key is not null").distinct()


def scene_refs(docs: DataFrame) -> DataFrame:
    """Every reference to a scene: pack, path, rel, pos (in the document), field, value, id_key."""
    entries = keyed(docs).filter("size(refs) > 0").select("pack", "path", "rel", F.posexplode("refs").alias("pos", "f"))
    return entries.select("pack", "path", "rel", "pos", "f.field", "f.value", F.col("f.key").alias("id_key"))


#: A table of so many distinct keys at most is sent to all tasks.
BROADCAST_KEYS = 200_000


def few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def unmatched(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``refs`` without a row of ``targets`` that has the same keys, none of which is null.

    Rows of references aren't shuffled: their distinct keys are, after each task has
    made its own distinct.  Keys that no target has are then looked for in the references.
    Few keys (counted) go to the targets instead, so that these aren't shuffled either; and few
    missing keys go to the references.  Of more, only keys are shuffled on either side.
    """
    wanted = stored(refs.select(*on).distinct())
    if few(wanted):
        there = targets.select(*on).join(wanted.hint("broadcast"), on, "left_semi").distinct()
        missing = wanted.join(there.hint("shuffle_merge"), on, "left_anti")
        return refs.join(missing.hint("broadcast"), on, "left_semi")
    missing = stored(wanted.join(targets.select(*on).hint("shuffle_merge"), on, "left_anti"))
    return refs.join(missing.hint("broadcast" if few(missing) else "shuffle_merge"), on, "left_semi")


def orphans(docs: DataFrame, fields: tuple[str, ...] = REF_KEYS) -> DataFrame:
    """References to ids that no document of the pack has, with their message: pack, path, rel, pos, field, value, message."""
    docs = keyed(docs)
    # A value without a key (a list) matches no id, and neither does this mark: keys of ids begin with their kind.
    refs = scene_refs(docs).filter(F.col("field").isin(*fields)).withColumn("id_key", F.coalesce("id_key", F.lit("-")))
    ids = docs.select("pack", "id_key").filter("id_key is not null")
    message = F.concat(F.lit("[cross-ref] "), F.col("path"), F.lit(": "), F.col("field"), F.lit(" '"), F.coalesce("value", F.lit("")), F.lit("' not found"))
    return unmatched(refs, ids, ["pack", "id_key"]).select("pack", "path", "rel", "pos", "field", "value", message.alias("message"))


def strict_tallies(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Optional rules: the distinct ``refs`` (pack, rule, target_type, id) whose id isn't one of the target type, with ``n``, how often each occurs.

    ``target_type`` null accepts an entity of any type.  ``entities``: pack, entity_type, id.
    References are read once: equal ones are counted as one before they meet any id, and of the entities
    only types that are a target of some reference are looked at.
    """
    columns = ["pack", "rule", "target_type", "id"]
    told = stored(refs.filter("coalesce(id, '') <> ''").groupBy(*columns).agg(F.count("*").alias("n")))
    kinds = [r[0] for r in told.select("target_type").filter("target_type is not null").distinct().collect()]  # types, a few
    out = unmatched(told.filter("target_type is not null"), entities.filter(F.col("entity_type").isin(kinds)).withColumnRenamed("entity_type", "target_type"), ["pack", "target_type", "id"])
    untyped = unmatched(told.filter("target_type is null"), entities, ["pack", "id"])
    return out.select(*columns, "n").unionByName(untyped.select(*columns, "n"))


def strict_orphans(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """The same as rows, each as often as it occurs."""
    return strict_tallies(refs, entities).withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def _declared() -> dict[str, list[tuple[str, str | None, str]]]:
    """Per type: rule, type of the target and SQL of an array of ids."""
    inventory = ("inventory_item", "items", "inventory.item_id")
    equipment = ("equipment_item", "items", "array(equipment.weapon, equipment.armor)")
    return {
        "scene_objects": [("object_scene", "scenes", "array(scene_id)"), ("loot_item", "items", "interact_data.loot_table.item_id")],
        "meta": [("starting_scene", "scenes", "array(starting_scene)")],
        "scenes": [("exit_target", "scenes", "exits.target_scene")],
        "lore": [("lore_reference", None, "references")],
        "actors": [inventory, equipment, ("shop_item", "items", "function_data.merchant.shop_inventory.item_id")],
        "player_characters": [inventory, equipment],
        "story_setup": [("arc_cast", "player_characters", "flatten(arcs.main_cast)")],
    }


def declared_refs(tables: dict[str, DataFrame]) -> DataFrame:
    """Every reference that the entity schemas declare, from the typed tables given: pack, rule, target_type, id.

    A table is read once, whatever the number of its rules.
    """
    union = None
    for kind, rules in _declared().items():
        if kind not in tables:
            continue
        each = ", ".join(
            f"transform(coalesce({ids}, cast(array() as array<string>)), i -> named_struct('rule', '{rule}', 'target_type', {repr(target) if target else 'cast(null as string)'}, 'id', i))"
            for rule, target, ids in rules
        )
        rows = tables[kind].select("pack", F.explode(F.expr(f"concat({each})")).alias("r")).select("pack", "r.*")
        union = rows if union is None else union.unionByName(rows)
    return union


def nested_domains(story: DataFrame) -> DataFrame:
    """Optional domain rules inside stories: pack, rule, value of hooks' urgency and arcs' type outside their lists."""
    hooks = "transform(hooks.urgency, v -> named_struct('rule', 'hook_urgency', 'value', v, 'bad', v not in ('low', 'medium', 'high')))"
    arcs = "transform(arcs.type, v -> named_struct('rule', 'arc_type', 'value', v, 'bad', v not in ('main', 'side')))"
    none = "cast(array() as array<struct<rule:string,value:string,bad:boolean>>)"
    each = F.explode(F.expr(f"concat(coalesce({hooks}, {none}), coalesce({arcs}, {none}))")).alias("r")
    return story.select("pack", each).filter("r.bad and r.value <> ''").select("pack", "r.rule", "r.value")


def ids_of(tables: dict[str, DataFrame]) -> DataFrame:
    """pack, entity_type and id of every entity of the typed tables."""
    union = None
    for kind, df in tables.items():
        if "id" in df.columns:
            rows = df.select("pack", F.lit(kind).alias("entity_type"), "id").filter("id is not null")
            union = rows if union is None else union.unionByName(rows)
    return union

