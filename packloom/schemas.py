"""Entity schemas and rule tables.  Rules are plain data: pass your own to the operators."""

from __future__ import annotations

# Required keys per entity type.  Order matters twice: types are matched
# in this order, and messages follow the order of the keys.
REQUIRED = {
    "meta": ["id", "name", "ruleset", "starting_scene"],
    "lore": ["id", "category", "content"],
    "scenes": ["id", "name", "type", "description"],
    "player_characters": ["id", "name", "role", "race", "personality", "attributes"],
    "actors": ["id", "name", "role", "race", "personality", "attributes"],
    "items": ["id", "name", "item_type"],
    "scene_objects": ["id", "name", "object_type", "scene_id"],
    "story_setup": ["arcs", "hooks"],
}

# Allowed strings per field name, whatever the entity type.
ALLOWED = {
    "type": ["indoor", "outdoor", "dungeon", "urban", "wilderness"],
    "category": ["geography", "history", "race", "faction", "culture", "magic", "religion"],
    "item_type": ["weapon", "armor", "shield", "potion", "scroll", "key", "consumable", "misc"],
    "object_type": ["chest", "door", "trap", "mechanism", "decoration"],
    "rarity": ["common", "uncommon", "rare", "legendary"],
    "urgency": ["low", "medium", "high"],
}

RESOURCES = ["lore", "scenes", "player_characters", "actors", "items", "scene_objects"]

_ATTRIBUTES = "attributes struct<str:int,dex:int,con:int,`int`:int,wis:int,cha:int>"
_COMBAT = "combat struct<hp:int,ac:int,attack_bonus:int,damage_bonus:int>"
_LINES = "array<struct<item_id:string,qty:int>>"

ENTITY_DDL = {
    "meta": "id string, name string, ruleset string, starting_scene string, description string",
    "lore": "id string, category string, content string, references array<string>",
    "scenes": (
        "id string, name string, type string, description string,"
        " environment struct<light:string,weather:string,temperature:int>,"
        " exits array<struct<target_scene:string,condition:string>>,"
        " landmarks array<struct<id:string,name:string,desc:string>>"
    ),
    "player_characters": (
        f"id string, name string, role string, race string, personality string, {_ATTRIBUTES}, {_COMBAT},"
        " character_arc struct<goal:string,flaw:string,turning_point:string>,"
        f" equipment struct<weapon:string,armor:string,accessories:array<string>>, inventory {_LINES}"
    ),
    "actors": (
        f"id string, name string, role string, race string, personality string, {_ATTRIBUTES}, {_COMBAT},"
        " functions array<string>,"
        f" function_data struct<merchant:struct<gold:int,shop_inventory:{_LINES}>,dialogue:struct<topics:array<string>>>,"
        f" equipment struct<weapon:string,armor:string>, inventory {_LINES}"
    ),
    "items": (
        "id string, name string, item_type string, rarity string, weight double, value int, description string,"
        " data struct<damage_dice:string,damage_type:string,ac_bonus:int,effect:string,amount:string>"
    ),
    "scene_objects": (
        "id string, name string, object_type string, scene_id string,"
        f" interact_data struct<locked:boolean,dc:int,loot_table:{_LINES},damage:string>"
    ),
    "story_setup": (
        "arcs array<struct<type:string,title:string,stage:string,main_cast:array<string>,"
        "branching_points:array<struct<trigger:string,next:string>>>>,"
        " hooks array<struct<description:string,urgency:string>>"
    ),
}

FIELD = "struct<pos:int,key:string,kind:string,value:string,truthy:boolean>"
DOCS_DDL = (
    "pack string, root string, path string, rel string, entity_type string,"
    f" parse_status string, fields array<{FIELD}>, body string"
)
PRESET_DDL = "name string, meta string, " + ", ".join(f"{r} array<string>" for r in RESOURCES) + ", story_setup string"
