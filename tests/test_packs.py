"""Packs as file trees: the rules, the readers' edge cases, generation and the round trip."""

import json

import pytest
import yaml

from packloom.operators import generate as G
from packloom.operators import load as L
from packloom.plans.generate import builtin_presets, generate, preset_rows
from packloom.plans.validate import load_valid, read_packs, validate, validate_roots
from packloom.schemas import DOCS_DDL
from packloom.sources.packtree import write_packs

SCORES = {"str": 9, "dex": 14, "con": 10, "int": 12, "wis": 7, "cha": 11}
SOUND = {
    "meta.yaml": {"id": "fen", "name": "The Fen", "ruleset": "d20", "starting_scene": "causeway"},
    "lore/reeds.yaml": {"id": "reeds", "category": "geography", "content": "Reeds as far as one can see."},
    "scenes/causeway.yaml": {"id": "causeway", "name": "Causeway", "type": "wilderness", "description": "Planks on mud."},
    "player_characters/ilo.yaml": {"id": "ilo", "name": "Ilo", "role": "guide", "race": "elf", "personality": "dry", "attributes": SCORES},
    "actors/toll.yaml": {"id": "toll", "name": "Toll keeper", "role": "guard", "race": "orc", "personality": "bored", "attributes": SCORES},
    "items/pole.yaml": {"id": "pole", "name": "Pole", "item_type": "misc", "rarity": "uncommon"},
    "scene_objects/gate.yaml": {"id": "gate", "name": "Gate", "object_type": "mechanism", "scene_id": "causeway"},
    "story_setup.yaml": {"arcs": [{"title": "High water"}], "hooks": [{"description": "The toll has doubled."}]},
}


def put(root, files):
    for rel, value in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(value if isinstance(value, bytes) else yaml.dump(value, allow_unicode=True).encode())
    return str(root)


def run(spark, root):
    v = validate_roots(spark, str(root))
    s = v.summary.collect()[0]
    return s.passed, s.failed, s.is_valid, sorted(r.message for r in v.errors.collect()), v


@pytest.mark.parametrize(
    "files, passed, failed, words",
    [
        (SOUND, 8, 0, []),
        ({"scenes/mill.yaml": {"name": "Mill", "type": "dungeon"}}, 0, 1, ["missing: description", "missing: id"]),
        ({"scenes/mill.yaml": {"id": "mill", "name": "Mill", "type": "attic", "description": "Flour."}}, 0, 1, ["invalid type: 'attic'"]),
        ({"meta.yaml": {"id": "fen", "name": "The Fen", "ruleset": "d20", "starting_scene": "ferry"}}, 1, 1, ["starting_scene 'ferry' not found"]),
        ({}, 0, 0, []),
        ({"scenes/e.yaml": b""}, 0, 1, ["description", "id", "name", "type"]),
        ({"_dir/.hidden.yaml": {"a": 1}, "notes.yml": {"a": 1}}, 1, 0, []),
        ({"items/bad.yaml": b"[unclosed"}, 0, 1, ["id", "item_type", "name"]),
        ({"items/two.yaml": b"a: 1\n---\nb: 2\n"}, 0, 1, ["id", "item_type", "name"]),
        ({"items/list.yaml": b"- 1\n"}, 0, 1, ["not_mapping"]),
        ({"items/latin.yaml": b"id: \xff\n"}, 0, 1, ["decode_error"]),
        ({"items/explore.yaml": {"id": "x"}}, 0, 1, ["category", "content"]),
        ({"scene_objects/a b.yaml": {"id": "1", "name": "n", "object_type": "door", "scene_id": 1}}, 1, 1, ["scene_id '1' not found"]),
        ({"scene_objects/n.yaml": {"id": 1, "name": "n", "object_type": "door", "scene_id": 1.0}}, 1, 0, []),
        ({"scene_objects/b.yaml": {"id": "b", "name": "n", "object_type": "portal", "scene_id": "zz"}}, 0, 2, ["invalid object_type", "zz"]),
    ],
)
def test_rules(spark, tmp_path, files, passed, failed, words):
    got = run(spark, put(tmp_path / "pack", files))
    assert got[:3] == (passed, failed, failed == 0)
    assert len(got[3]) == len(words) and all(any(w in m for m in got[3]) for w in words)


def test_report_and_missing_root(spark, tmp_path):
    root = put(tmp_path / "p", {"items/x.yaml": {"id": "x", "name": "n"}})
    text = run(spark, root)[4].report(root)
    assert text == "  items/x.yaml missing: item_type\n" + "-" * 50 + "\n0 passed, 1 failed"
    assert run(spark, tmp_path / "nowhere")[:3] == (0, 0, True)


def test_reports_put_errors_of_documents_first(spark, tmp_path):
    from packloom.operators import summary

    bad = {"items/x.yaml": {"id": "x", "name": "n"}, "lore/w.yaml": {"id": "w", "category": "rumor"}, "scene_objects/gate.yaml": {"id": "gate", "name": "G", "object_type": "door", "scene_id": "ferry"}}
    roots = [put(tmp_path / "p", SOUND | bad), put(tmp_path / "q", SOUND)]
    v = validate_roots(spark, roots)
    assert v.report(roots[1]) == "-" * 50 + "\n8 passed, 0 failed"
    lines = v.report(roots[0]).split("\n")
    assert lines == ["  items/x.yaml missing: item_type", "  lore/w.yaml missing: content", "  lore/w.yaml invalid category: 'rumor'", f"  [cross-ref] {roots[0]}/scene_objects/gate.yaml: scene_id 'ferry' not found", "-" * 50, "8 passed, 3 failed"]
    twice = summary.report_rows(v.errors.unionByName(v.errors), v.summary).filter(f"pack = '{roots[0]}'")
    assert twice.count() == 2 * 4 + 2


def test_report_covers_every_table(spark):
    from packloom.plans.queries import Q

    rows = Q["pack_report"](spark, "/root/testdata/sf0.001")
    kinds = {r.line.split("/")[0] for r in rows.filter("part = 0").collect()}
    assert {"  lore", "  player_characters", "  items", "  scene_objects"} <= kinds
    assert rows.filter("part < 2").count() == Q["all_errors"](spark, "/root/testdata/sf0.001").count()


def by_hand(files, root):
    """The rules in plain Python, one document after another."""
    from packloom.schemas import ALLOWED, REQUIRED

    passed, failed, errors, cross = 0, 0, [], set()
    loaded = {rel: yaml.safe_load(yaml.dump(v)) or {} for rel, v in files.items()}
    for rel, doc in loaded.items():
        kind = next((t for t in REQUIRED if t in rel), None)
        own = [f"{rel} missing: {k}" for k in REQUIRED.get(kind, []) if doc.get(k) in (None, "")] if kind else []
        own += [f"{rel} invalid {k}: '{v}'" for k, v in doc.items() if kind and isinstance(v, str) and v and v not in ALLOWED.get(k, [v])]
        passed, failed, errors = passed + (not own), failed + bool(own), errors + own
    ids = {d.get("id") for d in loaded.values()}
    for rel, doc in loaded.items():
        for k in ("scene_id", "starting_scene"):
            if doc.get(k) and doc[k] not in ids and (k == "scene_id" or "meta" in f"{root}/{rel}"):
                errors.append(f"[cross-ref] {root}/{rel}: {k} '{doc[k]}' not found")
                cross.add(errors[-1].split(":")[0])
    return passed, failed + len(cross), sorted(errors)


def test_random_packs_against_plain_rules(spark, tmp_path):
    import random

    rng = random.Random(4)
    folders = ["meta", "lore", "scenes", "player_characters", "actors", "items", "scene_objects", "props", "story_setup"]
    values = {"id": ["a", "b", 1, 1.0, True, "1", "", None], "type": ["indoor", "attic", 3, ""], "category": ["magic", "gossip"], "rarity": ["rare", "odd"], "scene_id": ["a", "z", 1, 0, "", None], "starting_scene": ["b", "y", 2], "name": ["n", "", None, []], "item_type": ["key", "kay"]}
    packs = {}
    for k in range(12):
        files = {}
        for i in range(rng.randrange(12)):
            keys = rng.sample(list(values), rng.randrange(len(values) + 1))
            files[f"{rng.choice(folders)}/{rng.choice(['e', 'metal', 'x y', 'lorenzo'])}{i}.yaml"] = {x: rng.choice(values[x]) for x in keys}
        packs[put(tmp_path / f"k{k}", files)] = files
        (tmp_path / f"k{k}").mkdir(exist_ok=True)
    v = validate_roots(spark, list(packs))
    got = {r.pack: (r.passed, r.failed) for r in v.summary.collect()}
    said = {root: sorted(r.message for r in v.errors.collect() if r.pack == root) for root in packs}
    for root, files in packs.items():
        passed, failed, errors = by_hand(files, root)
        assert (got[root], said[root]) == ((passed, failed), errors)
    again = validate(v.docs.repartition(7, "rel"), list(packs))
    assert {r.pack: (r.passed, r.failed) for r in again.summary.collect()} == got


@pytest.mark.parametrize(
    "folder, files, passed, failed, words",
    [
        ("metaverse", {"props/a.yaml": {"id": "a", "starting_scene": "q"}}, 1, 1, ["starting_scene 'q'"]),  # the root's name counts
        ("a:b", {"scene_objects/a.yaml": {"id": "a", "name": "n", "object_type": "door", "scene_id": "q"}, "scene_objects/b.yaml": {"id": "b", "name": "n", "object_type": "door", "scene_id": "q"}}, 2, 1, ["'q'", "'q'"]),  # one prefix
        ("p", {"items/metal.yaml": {"id": "m"}}, 0, 1, ["name", "ruleset", "starting_scene"]),  # first type in the name
        ("p", {"scene_objects/a.yaml": {"id": "pole", "name": "n", "object_type": "door", "scene_id": "pole"}}, 1, 0, []),  # any id will do
        ("p", {"items/tabs.yaml": b"a:\t- b\n\t- c", "items/tag.yaml": b"!odd x", "items/zero.yaml": b"0"}, 0, 3, 9 * [""]),
        ("p", {"items/n.yaml": b"id: 007\nname: 2024-01-01\nitem_type: yes\n"}, 1, 0, []),
        ("p", {"items/l.yaml": b"id: [a]\nname: n\nitem_type: key\n"}, 1, 0, []),
        ("p", {"items/r.yaml": {"id": "r", "name": "n", "item_type": "key", "urgency": "soon", "type": 4}}, 0, 1, ["invalid urgency: 'soon'"]),
        ("p", {"story_setup.yaml": {}}, 0, 1, ["arcs", "hooks"]),
    ],
)
def test_finer_points(spark, tmp_path, folder, files, passed, failed, words):
    got = run(spark, put(tmp_path / folder, files))
    assert got[:3] == (passed, failed, failed == 0)
    assert len(got[3]) == len(words) and all(any(w in m for m in got[3]) for w in words)


def test_folders_named_like_files_and_links_are_left_out(spark, tmp_path):
    root = tmp_path / "p"
    put(root, {"items/x.yaml/deep.yaml": {"id": "d", "name": "n", "item_type": "key"}, "items/é ü.yaml": {"id": "e", "name": "n", "item_type": "key"}})
    (root / "linked").symlink_to(root / "items")
    assert run(spark, root)[:3] == (2, 0, True)


def preset(spark, tmp_path, **more):
    e = lambda n, **k: [{"id": f"{n}{i}", "name": n} | k for i in (1, 2)]
    data = {
        "name": "vale",
        "meta": {"id": "vale", "name": "Vale", "ruleset": "d20", "starting_scene": "scene1"},
        "lore": [{"id": f"l{i}", "category": "history", "content": "草原"} for i in (1, 2)],
        "scenes": e("scene", type="urban", description="d"),
        "player_characters": e("pc", role="r", race="elf", personality="p", attributes={"str": 8}),
        "actors": e("actor", role="r", race="elf", personality="p", attributes={"str": 8}),
        "items": [{"id": f"i{i}", "name": "n", "item_type": "key"} for i in range(7)],
        "scene_objects": e("obj", object_type="door", scene_id="scene2"),
        "story_setup": {"arcs": [{"type": "main"}], "hooks": [{"urgency": "low"}]},
    } | more
    path = tmp_path / "preset.json"
    path.write_text(json.dumps(data, ensure_ascii=False))
    return G.read_presets(spark, str(path))


def test_generate_round_trip(spark, tmp_path):
    presets = G.pick_presets(preset(spark, tmp_path), ["vale"])
    write_packs(G.last_write_wins(G.expand(presets)), str(tmp_path / "out"))
    write_packs(G.last_write_wins(G.expand(presets)), str(tmp_path / "out"))  # again, over the first
    assert run(spark, tmp_path / "out/vale")[:3] == (19, 0, True)
    lore = L.sound(L.load_typed(read_packs(spark, str(tmp_path / "out/vale")), "lore")).collect()
    assert {r.content for r in lore} == {"草原"}
    with pytest.raises(ValueError, match="Unknown preset: nothing"):
        G.pick_presets(presets, ["nothing"])


def test_default_ids_follow_the_names_so_far(spark, tmp_path):
    items = [{"name": "a"}, {"id": "items_2"}, {"name": "b"}, {"name": "c"}, {"id": None}]
    got = G.expand(preset(spark, tmp_path, items=items, story_setup=None)).filter("entity_type in ('items', 'story_setup')").orderBy("entity_type", "pos").collect()
    assert [r.id for r in got[:5]] == ["items_0", "items_2", "items_2", "items_2", "None"]
    assert got[5].body == "{}"


def test_names_in_the_target_count(spark, tmp_path):
    one = preset_rows(spark, [{"name": "n", "meta": {"id": "n"}, "items": [{"name": "a"}, {"id": "b"}, {"name": "c"}]}])
    first = {r.rel for r in generate(spark, ["n"], str(tmp_path), one).collect()}
    assert first == {"meta.yaml", "story_setup.yaml", "items/items_0.yaml", "items/b.yaml", "items/items_2.yaml"}
    again = {r.rel for r in generate(spark, ["n"], str(tmp_path), one).collect()}
    assert again == {"meta.yaml", "story_setup.yaml", "items/items_3.yaml", "items/b.yaml", "items/items_4.yaml"}
    assert len(list((tmp_path / "n/items").iterdir())) == 5 and all((tmp_path / "n" / d).is_dir() for d in ("lore", "scenes", "actors"))


def test_builtin_preset_is_sound(spark, tmp_path):
    generate(spark, ["harbour"], str(tmp_path))
    v = validate_roots(spark, str(tmp_path / "harbour"))
    assert [(r.passed, r.failed) for r in v.summary.collect()] == [(12, 0)]
    typed = L.typed_tables(v.docs)
    from packloom.operators import refs

    assert refs.strict_orphans(refs.declared_refs(typed), refs.ids_of(typed)).count() == 0 and refs.nested_domains(typed["story_setup"]).count() == 0
    with pytest.raises(Exception, match="preset without meta"):
        G.expand(preset_rows(spark, [{"name": "x"}])).collect()
    assert G.limit_entities(G.expand(builtin_presets(spark)), {"items": 1}, ["faction"]).filter("entity_type in ('items', 'lore')").count() == 2


def test_flow_loads_valid_packs_only(spark, tmp_path):
    roots = [put(tmp_path / "in" / n, SOUND | more) for n, more in (("a", {}), ("b", {"items/x.yaml": {"id": "x"}}))]
    v = validate_roots(spark, roots)
    load_valid(v, str(tmp_path / "db"))
    read = lambda name: L.read_table(spark, str(tmp_path / "db"), name)
    assert {r.pack for r in read("items").collect()} == {roots[0]} and read("loot_lines").count() == 0
    assert read("story_hooks").select("description").first()[0] == "The toll has doubled."
    assert v.rejects.count() == 0


def test_load_replaces_packs_and_keeps_others(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "pack string, id string")
    packs = lambda *names: spark.createDataFrame([(n,) for n in names], "pack string")
    both = frame([("p1", "a"), ("p2", "b")])
    L.load_packs({"items": both, "loot_lines": both}, packs("p1", "p2"), str(tmp_path))
    L.load_packs({"items": frame([("p1", "c"), ("p3", "not named")]), "loot_lines": frame([])}, packs("p1"), str(tmp_path))
    read = lambda name: {(r.pack, r.id) for r in L.read_table(spark, str(tmp_path), name, both.schema).collect()}
    assert read("items") == {("p1", "c"), ("p2", "b")} and read("loot_lines") == {("p2", "b")}


def test_mistyped_values_are_told_apart(spark):
    row = lambda body: ("p", "p", "p/items/x", "items/x", "items", "ok", [], body)
    docs = spark.createDataFrame([row('{"id":"a","weight":"heavy"}'), row('{"id":"b","weight":1.5}')], DOCS_DDL)
    typed = L.load_typed(docs, "items")
    assert [r.id for r in L.sound(typed).collect()] == ["b"] and L.corrupt(typed).count() == 1


def test_vectors_have_unit_length(spark):
    texts = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three"), ("d", None)], "id string, text string")
    got = {r.id: r.vector for r in L.vectorise(texts).collect()}
    assert got["a"] == got["b"] and abs(got["a"].norm(2) - 1) < 1e-9


def test_streamed_rules_equal_batch(spark, tmp_path):
    from packloom.operators.summary import all_errors
    from packloom.streaming import file_rules as S

    root = put(tmp_path / "p", SOUND | {"items/x.yaml": {"id": "x"}})
    docs = read_packs(spark, root)
    docs.write.parquet(str(tmp_path / "docs"))
    S.write_errors(S.file_errors(S.read_docs(spark, str(tmp_path / "docs"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = sorted(r.message for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted(r.message for r in all_errors(docs).filter("stage = 0").collect())
