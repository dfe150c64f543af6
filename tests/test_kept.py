"""State that is kept between runs equals a full run; rules from tables; names and numbers of rows however they are dealt."""

import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_packs import SOUND, put

from packloom.functions.running import numbered
from packloom.operators import generate as G
from packloom.operators import load as L
from packloom.operators import refs, rules, summary
from packloom.plans.generate import preset_rows
from packloom.plans.validate import read_packs, validate_roots
from packloom.storage import stored


def random_lists(seed):
    rng = random.Random(seed)
    ids = [None, "x", "y", True, *[f"items_{k}" for k in range(9)], "items_01", "lore_1"]
    return [{"name": f"p{k}", "meta": {"id": "m"}, **{kind: [{} if i is None else {"id": i} for i in rng.choices(ids, [9, 1, 1, 1, *[1] * 11], k=rng.randrange(14))] for kind in ("items", "lore")}} for k in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_named_rows_equal_the_fold_over_arrays(spark, seed):
    presets = preset_rows(spark, random_lists(seed))
    rng = random.Random(seed)
    there = [(f"p{k}", kind, n) for k in range(30) for kind in ("items", "lore") for n in rng.sample(["x", "items_3", "items_5", "lore_0", "q", "items_10"], rng.randrange(4))]
    names = spark.createDataFrame(there, "pack string, entity_type string, name string")
    columns = ["pack", "entity_type", "pos", "id", "rel", "body"]
    for existing in (None, names):
        arrays = None if existing is None else existing.groupBy("pack", "entity_type").agg(F.collect_set("name").alias("names"))
        want = {tuple(r) for r in G.expand(presets, arrays).filter("entity_type in ('items', 'lore')").select(columns).collect()}
        got = [tuple(r) for r in G.named_rows(G.entity_rows(presets), existing).select(columns).collect()]
        assert set(got) == want and len(got) == len(want)
    assert G.named_rows(G.entity_rows(presets.limit(0))).count() == 0


def test_long_lists_are_rows(spark, tmp_path, monkeypatch):
    presets = preset_rows(spark, random_lists(5))
    files = spark.createDataFrame([("p1", "items/items_3.yaml"), ("p1", "items/x.yaml"), ("p2", "lore/lore_0.yaml"), ("p3", "meta.yaml")], "pack string, rel string")
    told = lambda: sorted(tuple(map(str, r)) for r in G.expand_over(presets, files).collect())
    short = told()
    monkeypatch.setattr(G, "LONG_LIST", 1)
    assert told() == short and len(short) > 200


def test_one_large_list_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are too small else
    rows = spark.range(4000).select(F.lit("p").alias("pack"), F.lit("items").alias("entity_type"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 2 == 0, '{"name":"n"}').otherwise(F.concat(F.lit('{"id":"e'), "id", F.lit('"}'))).alias("body"))
    got = {r.pos: r.id for r in G.named_rows(rows).collect()}
    assert got == {i: f"items_{i}" if i % 2 == 0 else f"e{i}" for i in range(4000)}
    from packloom.functions.running import dealt

    spread = dealt(rows, ["pack", "entity_type"], ["pos"]).groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2000


def test_numbers(spark):
    rows = [(g, i // 2, f"{i:03}") for g, n in (("a", 300), (None, 40), ("b", 1)) for i in range(n)]
    got = numbered(spark.createDataFrame(rows, "g string, i int, t string").repartition(5), ["g"], ["i", "t"], "no").collect()
    assert sorted((str(r.g), r.no, r.t) for r in got) == sorted((str(g), int(t) + 1, t) for g, _, t in rows)


def test_report_lines_follow_rules_then_the_document(spark, tmp_path):
    bad = {"items/x.yaml": {"rarity": "odd", "type": "attic", "item_type": "promo"}, "lore/w.yaml": {"category": "rumor", "id": "w"}, "scene_objects/gate.yaml": {"id": "gate", "name": "G", "object_type": "door", "scene_id": "ferry"}}
    v = validate_roots(spark, put(tmp_path / "p", SOUND | bad))
    lines = [r.line for r in summary.report_lines(v.errors, v.summary).orderBy("no").collect()]
    assert lines == v.report(str(tmp_path / "p")).split("\n")
    assert lines[:6] == [*[f"  items/x.yaml {m}" for m in ("missing: id", "missing: name", "invalid item_type: 'promo'", "invalid rarity: 'odd'", "invalid type: 'attic'")], "  lore/w.yaml missing: content"]


def test_rules_from_tables(spark, tmp_path, monkeypatch):
    files = SOUND | {"items/x.yaml": {"id": "x", "item_type": "promo", "rarity": "odd"}, "items/metal.yaml": {"id": ""}, "props/a.yaml": {"type": "attic"}, "lore/n.yaml": {"id": 4, "category": None}}
    roots = [put(tmp_path / n, files) for n in ("a", "b")]
    docs = stored(read_packs(spark, roots))
    messages = lambda *r: sorted((x.pack, x.message) for x in rules.with_file_errors(docs, *r).select("pack", F.explode("file_errors").alias("message")).collect())
    required, allowed = rules.rule_tables(spark)
    own = spark.createDataFrame([(roots[0], "items", 0, "weight"), (roots[0], "items", 1, "id"), (None, "items", 0, "id")], rules.REQUIRED_DDL)
    more = spark.createDataFrame([(roots[1], "rarity", "odd"), (roots[1], "rarity", "even"), (None, None, "x")], rules.ALLOWED_DDL)
    plain = messages()
    mixed = [m for m in plain if not (m[1].startswith("items/x.yaml missing") and m[0] == roots[0]) and not (m[0] == roots[1] and "rarity" in m[1])]
    mixed += [(roots[1], "items/pole.yaml invalid rarity: 'uncommon'")]
    mixed += [(roots[0], f"{f} missing: weight") for f in ("items/x.yaml", "items/pole.yaml")]
    for most in (500, 0):
        monkeypatch.setattr(rules, "LITERAL_RULES", most)
        assert messages(required, allowed) == plain
        assert messages(required.unionByName(own), allowed.unionByName(more)) == sorted(mixed)
        assert messages(required.limit(0), allowed.limit(0)) == []


def test_references_by_their_keys(spark, monkeypatch):
    rows = [("p", f"k{i % 50}", i) for i in range(300)] + [("q", "k1", 1), ("p", "gone", 2), ("p", "gone", 3)]
    links, ids = spark.createDataFrame(rows, "pack string, id string, n int"), spark.createDataFrame([("p", f"k{i}") for i in range(40)] * 2 + [("p", None)], "pack string, id string")
    want = sorted(r for r in rows if r[0] == "q" or r[1] == "gone" or int(r[1][1:]) >= 40)
    for most in (1000, 60, 5, 0):
        monkeypatch.setattr(refs, "BROADCAST_KEYS", most)
        assert sorted((r.pack, r.id, r.n) for r in refs.unmatched(links, ids, ["pack", "id"]).collect()) == want
    monkeypatch.setattr(refs, "BROADCAST_KEYS", 1000)
    out = refs.unmatched(links, ids, ["pack", "id"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "Scan ExistingRDD[pack" in plan
    before = plan[: plan.index("Scan ExistingRDD")]
    assert "Exchange hashpartitioning" not in before.split("+- BroadcastQueryStage")[0]  # the references meet what is missing where they lie


def test_tallies_that_are_kept(spark, tmp_path):
    first = {"a": SOUND, "b": SOUND | {"items/x.yaml": {"id": "x"}, "scene_objects/s.yaml": {"id": "s", "name": "s", "object_type": "door", "scene_id": "void"}}, "c": {}}
    roots = {n: put(tmp_path / n, f) for n, f in first.items()}
    for r in roots.values():
        (tmp_path / r).mkdir(exist_ok=True)
    state = summary.Tallies(spark, str(tmp_path / "state"), buckets=4)
    packs = lambda *ns: spark.createDataFrame([(roots[n],) for n in ns], "pack string")
    state.replace(packs("a", "b", "c"), stored(read_packs(spark, list(roots.values()))))
    full = lambda: sorted(tuple(r) for r in validate_roots(spark, list(roots.values())).summary.collect())
    assert sorted(tuple(r) for r in state.summary().collect()) == full()
    put(tmp_path / "b", {"items/x.yaml": {"id": "x", "name": "x", "item_type": "key"}, "meta.yaml": {"id": "fen", "name": "The Fen", "ruleset": "d20", "starting_scene": "void"}})
    (tmp_path / "b/scene_objects/s.yaml").unlink()
    state.replace(packs("b"), stored(read_packs(spark, roots["b"])))
    assert sorted(tuple(r) for r in state.summary().collect()) == full()


def test_frequencies_add_up_to_a_full_fit(spark, tmp_path):
    rows = [("p", "a", "one two three"), ("p", "b", "two two"), ("q", "c", None), ("q", "d", "three four"), ("r", "e", "five two one")]
    texts = spark.createDataFrame(rows, "pack string, id string, text string")
    packs = lambda *ns: spark.createDataFrame([(n,) for n in ns], "pack string")
    kept = L.Frequencies(spark, str(tmp_path / "df"), size=256)
    assert set(kept.inverse()) == {0.0}
    kept.replace(packs("p", "q"), texts.withColumn("text", F.lit("something else")))
    kept.replace(packs("r", "gone"), texts)
    kept.replace(packs("p", "q"), texts)
    full = {r.id: r.vector for r in L.vectorise(texts, size=256).collect()}
    got = {r.id: r.vector for r in kept.vectorise(texts).collect()}
    assert got.keys() == full.keys() and all(abs(got[k].toArray() - full[k].toArray()).max() < 1e-12 for k in full)
    kept.replace(packs("q"), texts.filter("pack = 'x'"))
    full = {r.id: r.vector for r in L.vectorise(texts.filter("pack <> 'q'"), size=256).collect()}
    got = {r.id: r.vector for r in kept.vectorise(texts.filter("pack <> 'q'")).collect()}
    assert all(abs(got[k].toArray() - full[k].toArray()).max() < 1e-12 for k in full)


def test_strict_references_are_read_once(spark, tmp_path, monkeypatch):
    rows = [("p", "r", "items", f"i{i % 4}") for i in range(40)] + [("p", "s", None, "x")] * 3 + [("p", "s", None, "i1")]
    spark.createDataFrame(rows, "pack string, rule string, target_type string, id string").write.parquet(str(tmp_path / "refs"))
    ids = spark.createDataFrame([("p", "items", "i1"), ("p", "scenes", "i2"), ("q", "items", "i3")], "pack string, entity_type string, id string")
    for most in (1, 1000):
        monkeypatch.setattr(refs, "BROADCAST_KEYS", most)
        links = spark.read.parquet(str(tmp_path / "refs"))
        told, each = refs.strict_tallies(links, ids), refs.strict_orphans(links, ids)
        if most == 1000:
            shutil.rmtree(tmp_path / "refs")
        assert sorted((r.rule, r.id, r.n) for r in told.collect()) == [("r", "i0", 10), ("r", "i2", 10), ("r", "i3", 10), ("s", "x", 3)]
        assert each.count() == 33


def test_rows_without_a_name_are_spread_over_tasks(spark):
    rows = spark.range(4000).select(F.lit("p").alias("pack"), F.lit(None).cast("string").alias("given"), F.col("id").alias("pos"))
    other = spark.createDataFrame([("p", "x", 1)], "pack string, given string, old int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = G.spread_join(rows, other, ["pack"], "given", ["pos"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_prefixes_of_few_packs_are_not_dealt_out_by_pack(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("p", "p/items/a.yaml", "items/a.yaml", "items", "ok")], "pack string, path string, rel string, entity_type string, parse_status string")
    docs = docs.selectExpr("*", "cast(array() as array<struct<pos:int,key:string,kind:string,value:string,truthy:boolean>>) fields", "'s:a' id_key", "array(named_struct('field', 'scene_id', 'value', 'b', 'key', 's:b')) refs")
    plans, plain = [], summary.stored
    monkeypatch.setattr(summary, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    state = summary.Tallies(spark, str(tmp_path / "state"), buckets=2)
    state.replace(docs.select("pack"), docs)
    assert not any("SortMergeJoin [pack" in line and "LeftSemi" in line for plan in plans for line in plan.split("\n"))
    assert [tuple(r) for r in state.summary().collect()] == [("p", 0, 2, False)]
