"""Generation in one call: preset names to a tree of files, and the presets that come with the library."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from packloom.operators import generate as G
from packloom.schemas import PRESET_DDL, RESOURCES
from packloom.sources.packtree import list_files, write_packs
from packloom.storage import stored

_SMALL = {"str": 8, "dex": 12, "con": 9, "int": 13, "wis": 11, "cha": 10}

#: A small pack to start from.
HARBOUR = {
    "name": "harbour",
    "meta": {"id": "harbour", "name": "The Harbour of Oss", "ruleset": "d20", "starting_scene": "quay"},
    "lore": [
        {"id": "tides", "category": "geography", "content": "Twice a day the sea leaves the basin dry.", "references": ["quay"]},
        {"id": "pilots", "category": "faction", "content": "The pilots' guild keeps the only charts.", "references": ["tides"]},
    ],
    "scenes": [
        {"id": "quay", "name": "Quay", "type": "urban", "description": "Wet stones and rope.", "exits": [{"target_scene": "loft", "condition": ""}]},
        {"id": "loft", "name": "Sail loft", "type": "indoor", "description": "Canvas to the rafters.", "exits": [{"target_scene": "quay", "condition": ""}]},
    ],
    "player_characters": [{"id": "mara", "name": "Mara", "role": "pilot", "race": "human", "personality": "patient", "attributes": _SMALL, "inventory": [{"item_id": "lead", "qty": 1}]}],
    "actors": [{"id": "sailmaker", "name": "Brun", "role": "merchant", "race": "dwarf", "personality": "curt", "attributes": _SMALL, "equipment": {"weapon": "awl", "armor": ""}}],
    "items": [{"id": "lead", "name": "Sounding lead", "item_type": "misc", "rarity": "common", "value": 2}, {"id": "table", "name": "Tide table", "item_type": "scroll"}, {"id": "awl", "name": "Awl", "item_type": "weapon"}],
    "scene_objects": [{"id": "chart_chest", "name": "Chart chest", "object_type": "chest", "scene_id": "loft", "interact_data": {"locked": True, "dc": 12, "loot_table": [{"item_id": "lead", "qty": 2}]}}],
    "story_setup": {"arcs": [{"type": "main", "title": "The missing chart", "stage": "hook", "main_cast": ["mara"]}], "hooks": [{"description": "A ship is overdue.", "urgency": "high"}]},
}


def preset_rows(spark: SparkSession, presets: list[dict]) -> DataFrame:
    """Presets given as dictionaries, as ``read_presets`` returns those of files; absent keys stay absent."""
    text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
    rows = [(p["name"], text(p.get("meta")), *[None if p.get(r) is None else [text(e) for e in p[r]] for r in RESOURCES], text(p.get("story_setup"))) for p in presets]
    return spark.createDataFrame(rows, PRESET_DDL)


def builtin_presets(spark: SparkSession) -> DataFrame:
    return preset_rows(spark, [HARBOUR])


def generate(spark: SparkSession, names: list[str], out: str, presets: DataFrame | None = None) -> DataFrame:
    """Write the packs of these presets as file trees ``<out>/<name>`` and return their entity rows.

    Default ids count on from the files that a target has already, so they are listed
    before anything is written; files of the same name are replaced and others stay.
    """
    picked = G.pick_presets(builtin_presets(spark) if presets is None else presets, names)
    out = out.rstrip("/")
    there = list_files(spark, [f"{out}/{n}" for n in names]).selectExpr(f"substring(pack, {len(out) + 2}) as pack", "rel")
    entities = stored(G.last_write_wins(G.expand_over(picked, there)))
    write_packs(entities, out)
    return entities
