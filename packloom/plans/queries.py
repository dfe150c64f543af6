"""Registered queries over the star-schema tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators import generate as G
from packloom.operators import load as L
from packloom.operators import refs as R
from packloom.operators import rules, summary
from packloom.operators.classify import classify, type_counts, with_rel
from packloom.plans import validate as V
from packloom.schemas import ALLOWED, ENTITY_DDL, REQUIRED
from packloom.sources import tables as T
from packloom.storage import new_path, stored

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# The same documents in plain SQL: one row per document, then one per field.
_TYPE = "case " + " ".join(f"when contains(rel, '{t}') then '{t}'" for t in REQUIRED) + " end"
_FIELD_ROWS = """
 select 'w'||r_regionkey pack, 'meta.yaml' rel, unnest(['id','name','ruleset','starting_scene']) k,
   unnest(['w'||r_regionkey, r_name, case when r_regionkey=4 then '' else 'd20' end, case when r_regionkey=3 then 's99' else 's'||r_regionkey end]) v, true s from region
 union all select 'w'||(n_nationkey%5), 'scenes/s'||n_nationkey||'.yaml', unnest(['id','name','type','description']),
   unnest(['s'||n_nationkey, n_name, ['indoor','outdoor','dungeon','urban','wilderness','space'][n_nationkey%6+1], case when n_nationkey%7<>0 then 'The land of '||n_name end]), true from nation
 union all select 'w'||(c_nationkey%5), 'player_characters/c'||c_custkey||'.yaml', unnest(['id','name','role','race','personality','attributes']),
   unnest(['c'||c_custkey, c_name, lower(c_mktsegment), case when c_acctbal>=0 then 'human' end, 'calm', 'map']), true from customer
 union all select 'w'||(s_nationkey%5), 'actors/a'||s_suppkey||'.yaml', unnest(['id','name','role','race','personality','attributes']),
   unnest(['a'||s_suppkey, s_name, 'merchant', 'dwarf', case when s_acctbal<0 then '' else 'calm' end, 'map']), true from supplier
 union all select 'w'||(p_partkey%5), 'items/i'||p_partkey||'.yaml', unnest(['id','name','item_type','rarity','value']),
   unnest(['i'||p_partkey, p_name, case split_part(p_type,' ',1) when 'ECONOMY' then 'weapon' when 'LARGE' then 'armor' when 'MEDIUM' then 'potion' when 'SMALL' then 'key' when 'STANDARD' then 'misc' else lower(split_part(p_type,' ',1)) end,
     ['common','uncommon','rare','legendary','mythic'][p_size%5+1], p_size::varchar]), true from part
 union all select 'w'||(o_orderkey%5), 'scene_objects/o'||o_orderkey||'.yaml', unnest(['id','name','object_type','scene_id']),
   unnest(['o'||o_orderkey, 'object '||o_orderkey, case o_orderstatus when 'F' then 'chest' when 'O' then 'door' else 'portal' end, 's'||(o_orderkey%30)]), true from orders
 union all select 'w'||(doc_id%5), 'lore/d'||doc_id||'.yaml', unnest(['id','category','content']),
   unnest(['d'||doc_id, ['geography','history','race','faction','culture','magic','religion','rumor'][substr(source,4)::int%8+1], text]), true from documents
 union all select 'w'||p, 'story_setup.yaml', unnest(['arcs','hooks']), unnest(['seq','seq']), false from (select distinct conv_id%5 p from conversations)
"""
_REQUIRED_ROWS = ", ".join(f"('{t}','{k}')" for t, ks in REQUIRED.items() for k in ks)
_ALLOWED = " or ".join(f"(k='{k}' and v not in ({', '.join(map(repr, vs))}))" for k, vs in ALLOWED.items())
_BASE = f"""with f as ({_FIELD_ROWS}),
 d as (select distinct pack, rel, {_TYPE} et from f),
 req(et, k) as (values {_REQUIRED_ROWS}),
 missing as (select d.pack, d.rel, d.rel||' missing: '||req.k message from d join req using (et)
   left join f on f.pack=d.pack and f.rel=d.rel and f.k=req.k where f.v is null or f.v=''),
 invalid as (select pack, rel, rel||' invalid '||k||': '''||v||'''' message from f where {_TYPE} is not null and v<>'' and ({_ALLOWED})),
 own as (select * from missing union all select * from invalid),
 ids as (select distinct pack, v from f where k='id' and v<>''),
 orphan as (select f.pack, f.pack||'/'||f.rel path, f.k field, '[cross-ref] '||f.pack||'/'||f.rel||': '||f.k||' '''||f.v||''' not found' message
   from f left join ids on ids.pack=f.pack and ids.v=f.v
   where f.v<>'' and (f.k='scene_id' or (f.k='starting_scene' and contains(f.pack||'/'||f.rel, 'meta'))) and ids.v is null),
 bad as (select distinct pack, rel from own),
 tally as (select d.pack, count(*) filter (where bad.rel is null) okn, count(*) filter (where bad.rel is not null) badn from d left join bad using (pack, rel) group by 1),
 cross_n as (select pack, count(distinct split_part(message, ':', 1)) n from orphan group by 1),
 summ as (select pack, okn::bigint passed, (badn + coalesce(n,0))::bigint failed, badn + coalesce(n,0) = 0 is_valid from tally left join cross_n using (pack))
"""


@query(_BASE + "select et entity_type, count(*) n from d group by 1")
def classify_counts(spark: SparkSession, sf: str) -> DataFrame:
    return type_counts(T.docs(spark, sf))


@query(f"""with r as (select unnest(['items/'||p_name||'_'||p_partkey||'.yaml', 'actors/explore_'||p_partkey||'.yaml', 'items/metal_'||p_partkey||'.yaml',
 'scene_objects/scenes_'||p_partkey||'.yaml', 'props/'||p_partkey||'.yaml']) rel from part) select rel, {_TYPE} entity_type from r""")
def classify_order(spark, sf):
    """Names that hold several type names: the first in rule order wins."""
    k = F.col("p_partkey").cast("string")
    rels = F.array(
        F.concat(F.lit("items/"), "p_name", F.lit("_"), k, F.lit(".yaml")),
        *[F.concat(F.lit(p), k, F.lit(".yaml")) for p in ("actors/explore_", "items/metal_", "scene_objects/scenes_", "props/")],
    )
    return classify(T.table(spark, sf, "part").select(F.explode(rels).alias("rel"))).select("rel", "entity_type")


@query(_BASE + "select rel, message from missing")
def missing_fields(spark, sf):
    return T.docs(spark, sf).select("rel", F.explode(rules.missing_messages()).alias("message"))


@query(_BASE + "select rel, message from invalid")
def invalid_values(spark, sf):
    docs = T.docs(spark, sf).filter("entity_type is not null")
    return docs.select("rel", F.explode(rules.invalid_messages()).alias("message"))


@query("select 'w'||(o_orderkey%5) pack, count(*) n from orders group by 1")
def unclassified_pass(spark, sf):
    """Documents outside the type folders have no rules: all pass, whatever they lack."""
    docs = T.entity_docs(spark, sf, "orders")
    moved = docs.withColumn("rel", F.concat(F.lit("props/"), F.substring_index("rel", "/", -1))).withColumn("entity_type", F.lit(None).cast("string"))
    return rules.file_status(moved).filter("ok").groupBy("pack").agg(F.count("*").alias("n"))


@query(_BASE + "select d.pack, d.rel, bad.rel is null ok from d left join bad on bad.pack=d.pack and bad.rel=d.rel")
def file_status(spark, sf):
    return rules.file_status(T.docs(spark, sf))


@query(_BASE + "select pack, count(*) n_ids from ids group by 1")
def id_pool(spark, sf):
    return R.id_pool(T.docs(spark, sf)).groupBy("pack").agg(F.count("*").alias("n_ids"))


@query(_BASE + "select path, message from orphan where field='scene_id'")
def orphan_scene_id(spark, sf):
    return R.orphans(T.docs(spark, sf), ("scene_id",)).select("path", "message")


@query(_BASE + "select path, message from orphan where field='starting_scene'")
def orphan_starting_scene(spark, sf):
    return R.orphans(T.docs(spark, sf), ("starting_scene",)).select("path", "message")


@query("""select 'w'||(o_orderkey%5)||'/scene_objects/o'||o_orderkey||'.yaml' path,
 '[cross-ref] w'||(o_orderkey%5)||'/scene_objects/o'||o_orderkey||'.yaml: scene_id ''o'||(o_orderkey+(o_orderkey%2)*5000000000)||''' not found' message
 from orders where o_orderkey%2=1""")
def crossref_global_pool(spark, sf):
    """A scene reference to any document's id holds, even to the own one."""
    docs = T.entity_docs(spark, sf, "orders")
    own = F.regexp_extract("rel", r"o(\d+)\.yaml", 1).cast("bigint")
    value = F.concat(F.lit("o"), (own + (own % 2) * 5_000_000_000).cast("string"))
    changed = F.transform("fields", lambda f: F.when(f["key"] == "scene_id", f.withField("value", value)).otherwise(f))
    return R.orphans(docs.drop("id_key", "refs").withColumn("fields", changed)).select("path", "message")


@query(_BASE + "select pack, 0 stage, message from own union all select pack, 1, message from orphan")
def all_errors(spark, sf):
    return summary.all_errors(T.docs(spark, sf))


@query(_BASE + "select pack, n from cross_n")
def crossref_failures(spark, sf):
    return summary.crossref_failures(summary.all_errors(T.docs(spark, sf)))


@query(_BASE + "select pack, passed, failed, is_valid from summ")
def pack_summary(spark, sf):
    return summary.pack_summary(T.docs(spark, sf))


_LINES = """select pack, 0 part, '  '||message line from own union all select pack, 1, '  '||message from orphan
 union all select pack, 2, repeat('-',50) from summ union all select pack, 3, passed||' passed, '||failed||' failed' from summ"""


@query(_BASE + _LINES)
def pack_report(spark, sf):
    """All reports line by line, errors of single documents first; sorted by part and line, a pack's rows are its report."""
    v = V.validate(T.docs(spark, sf))
    return summary.report_rows(v.errors, v.summary).select("pack", "part", "line")


@query(_BASE + f"select pack, greatest(part - 1, 0)::int part, line from ({_LINES})")
def pack_report_rows(spark, sf):
    """The same lines in three parts: errors, the rule, the counts."""
    return pack_report(spark, sf).withColumn("part", F.greatest(F.col("part") - 1, F.lit(0)))


_ORDERED = f"""{_BASE}, pos_f(et, k, p) as (values {", ".join(f"('{t}','{k}',{i})" for t, ks in REQUIRED.items() for i, k in enumerate(ks))}),
 doc_pos(k, p) as (values ('id',0),('name',1),('category',1),('ruleset',2),('type',2),('item_type',2),('object_type',2),('role',2),('rarity',3)),
 numbered as (select pack, 0 part, rel, 0 sub, pos_f.p p, '  '||message line from missing join pos_f on contains(missing.rel, pos_f.et) and pos_f.et = (select et from d where d.pack = missing.pack and d.rel = missing.rel) and message = rel||' missing: '||pos_f.k
  union all select pack, 0, rel, 1, doc_pos.p, '  '||message from invalid join doc_pos on starts_with(message, rel||' invalid '||doc_pos.k||':')
  union all select pack, 1, substr(path, length(pack) + 2), 0, 0, '  '||message from orphan
  union all select pack, 2, '', 0, 0, repeat('-', 50) from summ union all select pack, 3, '', 0, 0, passed||' passed, '||failed||' failed' from summ)
 select pack, row_number() over (partition by pack order by part, rel, sub, p) no, line from numbered"""


@query(_ORDERED)
def pack_report_lines(spark, sf):
    """All reports with numbered lines: errors of a document in the order of the rules, then in that of the document."""
    v = V.validate(T.docs(spark, sf))
    return summary.report_lines(v.errors, v.summary)


@query(_BASE + "select pack, passed, failed, is_valid from summ")
def kept_tallies(spark, sf):
    """Tallies of all packs but w1 and of w2 in a state that isn't right, then both replaced."""
    docs = T.docs(spark, sf)
    state = summary.Tallies(spark, new_path(spark, "tallies"), 8)
    names = docs.select("pack").distinct()
    state.replace(names.filter("pack <> 'w1'"), docs.filter("pack not in ('w1', 'w2') or pack = 'w2' and rel like '%7.yaml'"))
    state.replace(names.filter("pack in ('w1', 'w2')"), docs.filter("pack in ('w1', 'w2')"))
    return state.summary()


_PRESET = """with o as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey)-1 pos from orders),
 e as (select 'p'||c_custkey pack, 'meta' entity_type, 0 pos, 'p'||c_custkey id, 'meta.yaml' rel from customer
 union all select 'p'||c_custkey, 'story_setup', 0, null, 'story_setup.yaml' from customer
 union all select 'p'||o_custkey, 'scene_objects', pos, case when o_orderkey%3<>0 then 'o'||o_orderkey else 'scene_objects_'||pos end,
   'scene_objects/'||case when o_orderkey%3<>0 then 'o'||o_orderkey else 'scene_objects_'||pos end||'.yaml' from o join customer on c_custkey=o_custkey) """


@query(_PRESET + "select pack, entity_type, rel, id from e")
def preset_expand(spark, sf):
    return G.expand(T.presets(spark, sf)).select("pack", "entity_type", "rel", "id")


@query(_PRESET + "select rel, count(*) n from e where entity_type='scene_objects' and id like 'scene_objects%' group by 1")
def default_ids(spark, sf):
    named = G.expand(T.presets(spark, sf)).filter("entity_type = 'scene_objects' and id like 'scene_objects%'")
    return named.groupBy("rel").agg(F.count("*").alias("n"))


@query(_PRESET + "select entity_type, count(*) n from e where entity_type<>'scene_objects' or pos<3 group by 1")
def limited_entities(spark, sf):
    return G.limit_entities(G.expand(T.presets(spark, sf)), {"scene_objects": 3}).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey)-1 pos, count(*) over (partition by o_custkey) n,
  count(*) filter (where o_orderkey%3=0) over (partition by o_custkey order by o_orderkey) d from orders join customer on c_custkey=o_custkey)
 select 'p'||o_custkey pack, pos::int pos, case when o_orderkey%3<>0 then 'o'||o_orderkey else 'scene_objects_'||(n+d-1) end id from o""")
def default_ids_rerun(spark, sf):
    """A second run over the first one's files: explicit names are there already, default ones count on."""
    presets = T.presets(spark, sf)
    there = G.existing_names(G.expand(presets).select("pack", "rel"))
    return G.expand(presets, there).filter("entity_type = 'scene_objects'").select("pack", "pos", "id")


@query("select 'p'||c_custkey as name from customer where c_nationkey%2=0")
def preset_lookup(spark, sf):
    wanted = T.table(spark, sf, "customer").filter("c_nationkey % 2 = 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"))
    return G.pick_presets(T.presets(spark, sf), wanted).select("name")


@query("""select 'w'||(doc_id%5) pack, ['geography','history','race','faction','culture','magic','religion','rumor'][substr(source,4)::int%8+1] category, count(*) n
 from documents where substr(source,4)::int%8 in (1, 5) group by 1, 2""")
def limited_categories(spark, sf):
    lore = T.entity_docs(spark, sf, "documents").select("pack", "entity_type", F.lit(0).alias("pos"), "rel", F.to_json(F.struct(F.get_json_object("body", "$.category").alias("category"))).alias("body"))
    kept = G.limit_entities(lore, categories=["history", "magic"])
    return kept.groupBy("pack", F.get_json_object("body", "$.category").alias("category")).agg(F.count("*").alias("n"))


@query(_PRESET + "select entity_type, count(*) n from e group by 1")
def entity_table(spark, sf):
    """Expanded presets written as a table and read again."""
    path = new_path(spark, "entities")
    G.write_entities(G.expand(T.presets(spark, sf)), path)
    return G.entity_table(spark, path).read().groupBy("entity_type").agg(F.count("*").alias("n"))


@query("""select 'items/'||l_partkey||'.yaml' rel, max_by(l_orderkey, l_orderkey*10+l_linenumber) as value from lineitem group by 1""")
def last_write_wins(spark, sf):
    """Every order line writes its part; the last line's file stays."""
    li = T.table(spark, sf, "lineitem")
    rows = li.select(
        F.lit("w").alias("pack"),
        F.concat(F.lit("items/"), F.col("l_partkey").cast("string"), F.lit(".yaml")).alias("rel"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_orderkey").cast("string").alias("body"),
    )
    return G.last_write_wins(rows).select("rel", F.col("body").cast("bigint").alias("value"))


@query("""select 'w'||(c_nationkey%5) pack, 'player_characters/c'||c_custkey||'.yaml' rel, case when c_custkey%3=0 then 'new' else 'old' end as which from customer
 union all select 'w'||(s_nationkey%5), 'actors/a'||s_suppkey||'.yaml', 'new' from supplier""")
def merge_runs(spark, sf):
    """A second run replaces a third of the files, adds others and leaves the rest."""
    old = T.entity_docs(spark, sf, "customer").select("pack", "rel", F.lit("old").alias("which"))
    third = T.entity_docs(spark, sf, "customer").filter(F.regexp_extract("rel", r"c(\d+)", 1).cast("int") % 3 == 0)
    new = third.unionByName(T.entity_docs(spark, sf, "supplier")).select("pack", "rel", F.lit("new").alias("which"))
    return G.merge_run(old, new)


def _typed(name, kind, cols, sql):
    def run(spark, sf):
        return L.sound(L.load_typed(T.entity_docs(spark, sf, name), kind)).select("pack", *cols)

    run.__name__ = f"typed_{kind}"
    query(sql)(run)


_WIDE = f"with f as ({_FIELD_ROWS}) select pack, "
for _name, _kind, _cols in (
    ("region", "meta", ["id", "name", "ruleset", "starting_scene"]),
    ("documents", "lore", ["id", "category", "content"]),
    ("nation", "scenes", ["id", "name", "type", "description"]),
    ("customer", "player_characters", ["id", "name", "role", "race", "personality"]),
    ("supplier", "actors", ["id", "name", "role", "race", "personality"]),
    ("part", "items", ["id", "name", "item_type", "rarity"]),
    ("orders", "scene_objects", ["id", "name", "object_type", "scene_id"]),
):
    _typed(_name, _kind, _cols, _WIDE + ", ".join(f"max(v) filter (where k='{x}') as {x}" for x in _cols) + f" from f where {_TYPE}='{_kind}' group by pack, rel")


def _tables(spark, sf, *kinds):
    return {kind: T.typed(spark, sf, kind) for kind in kinds or ENTITY_DDL}


@query("select 'w'||(conv_id%5) pack, case role when 'system' then 'high' when 'assistant' then 'medium' else 'low' end urgency, text description from conversations")
def story_hooks(spark, sf):
    return L.child_tables(_tables(spark, sf, "story_setup"))["story_hooks"].select("pack", "urgency", "description")


@query("select 'w'||(conv_id%5) pack, 'main' \"type\", 'conversation '||conv_id title from conversations where turn=0")
def story_arcs(spark, sf):
    return L.child_tables(_tables(spark, sf, "story_setup"))["story_arcs"].select("pack", "type", "title")


@query("""select 'w'||(n_nationkey%5) pack, 's'||n_nationkey owner_id, 's'||((n_nationkey+5)%25) target_scene, '' condition from nation
 union all select 'w'||(n_nationkey%5), 's'||n_nationkey, case when n_nationkey%7=0 then 's77' else 's'||((n_nationkey+10)%25) end, 'locked' from nation""")
def scene_exits(spark, sf):
    return L.child_tables(_tables(spark, sf, "scenes"))["scene_exits"].select("pack", "owner_id", "target_scene", "condition")


@query("select 'w'||(l_orderkey%5) pack, 'o'||l_orderkey||'_'||l_linenumber owner_id, 'i'||l_partkey item_id, l_quantity::int qty from lineitem")
def loot_lines(spark, sf):
    return L.child_tables(_tables(spark, sf, "scene_objects"))["loot_lines"].select("pack", "owner_id", "item_id", "qty")


_LINE_SQL = {
    "inventory_lines": """select 'w'||(s_nationkey%5) pack, 'actors' owner_type, 'a'||s_suppkey owner_id, 'i'||(s_suppkey*10+s_nationkey%5) item_id, 3 qty from supplier
 union all select 'w'||(c_nationkey%5), 'player_characters', 'c'||c_custkey, 'i'||(c_custkey*5+c_nationkey%5), (c_custkey%3+1)::int from customer""",
    "shop_lines": """select 'w'||(s_nationkey%5) pack, 'actors' owner_type, 'a'||s_suppkey owner_id, 'i'||(s_suppkey*5+s_nationkey%5) item_id, 1 qty from supplier
 union all select 'w'||(s_nationkey%5), 'actors', 'a'||s_suppkey, 'i'||s_suppkey, 2 from supplier""",
}


def _parsed(spark, sf, *kinds):
    """Typed tables by way of documents and their JSON."""
    return {kind: L.sound(L.load_typed(T.nested_docs(spark, sf, kind), kind)) for kind in kinds}


@query(_LINE_SQL["inventory_lines"])
def inventory_lines(spark, sf):
    return L.child_tables(_parsed(spark, sf, "actors", "player_characters"))["inventory_lines"].drop("pos")


@query(_LINE_SQL["shop_lines"])
def shop_lines(spark, sf):
    return L.child_tables(_parsed(spark, sf, "actors"))["shop_lines"].drop("pos")


@query("select 'w'||(n_nationkey%5) pack, 's'||n_nationkey owner_id, 'm'||n_nationkey id, 'Stone of '||n_name as name from nation")
def scene_landmarks(spark, sf):
    return L.child_tables(_parsed(spark, sf, "scenes"))["scene_landmarks"].select("pack", "owner_id", "id", "name")


@query("""select 'w'||(conv_id%5) pack, 'story_setup/v'||conv_id||'_'||turn||'.yaml' rel, case when turn=0 then 1 else 0 end n_arcs, 1 n_hooks,
 case when turn=0 then 'conversation '||conv_id end title, case role when 'system' then 'high' when 'assistant' then 'medium' else 'low' end urgency from conversations""")
def typed_story_setup(spark, sf):
    story = _parsed(spark, sf, "story_setup")["story_setup"]
    n_arcs = F.coalesce(F.size("arcs"), F.lit(0))
    return story.select("pack", "rel", F.greatest(n_arcs, F.lit(0)).alias("n_arcs"), F.size("hooks").alias("n_hooks"), F.get("arcs", F.lit(0))["title"].alias("title"), F.get("hooks", F.lit(0))["urgency"].alias("urgency"))


@query(f"""with items as (select 'w'||(p_partkey%5) pack, 'i'||p_partkey id from part), scenes as (select 'w'||(n_nationkey%5) pack, 's'||n_nationkey id from nation),
 cast_ as (select 'w'||(c_nationkey%5) pack, 'c'||c_custkey id from customer), lore as (select 'w'||(doc_id%5) pack, 'd'||doc_id id from documents),
 t as (select 'items' tt, pack, id from items union all select 'scenes', pack, id from scenes union all select 'cast', pack, id from cast_
  union all select 'any', pack, id from scenes union all select 'any', pack, id from lore),
 r as (select 'w'||(l_orderkey%5) pack, 'loot_item' as rule, 'items' tt, 'i'||l_partkey id from lineitem
  union all select 'w'||(l_orderkey%5), 'object_scene', 'scenes', 's'||(l_orderkey%30) from lineitem
  union all select 'w'||r_regionkey, 'starting_scene', 'scenes', case when r_regionkey=3 then 's99' else 's'||r_regionkey end from region
  union all select 'w'||(n_nationkey%5), 'exit_target', 'scenes', 's'||((n_nationkey+5)%25) from nation
  union all select 'w'||(n_nationkey%5), 'exit_target', 'scenes', case when n_nationkey%7=0 then 's77' else 's'||((n_nationkey+10)%25) end from nation
  union all select 'w'||(doc_id%5), 'lore_reference', 'any', 's'||(doc_id%30) from documents
  union all select 'w'||(doc_id%5), 'lore_reference', 'any', 'd'||doc_id from documents
  union all select pack, 'inventory_item', 'items', item_id from ({_LINE_SQL["inventory_lines"]})
  union all select pack, 'shop_item', 'items', item_id from ({_LINE_SQL["shop_lines"]})
  union all select 'w'||(c_nationkey%5), 'equipment_item', 'items', unnest(['i'||c_custkey, case when c_custkey%2=0 then 'i'||(c_custkey+5) else '' end]) from customer
  union all select 'w'||(s_nationkey%5), 'equipment_item', 'items', unnest(['i'||s_suppkey, case when s_suppkey%2=0 then 'i'||(s_suppkey+5) else '' end]) from supplier
  union all select 'w'||(conv_id%5), 'arc_cast', 'cast', 'c'||conv_id from conversations where turn=0)
 select r.pack, r.rule, count(*) n from r left join t on t.tt=r.tt and t.pack=r.pack and t.id=r.id where t.id is null and r.id<>'' group by 1, 2""")
def strict_refs(spark, sf):
    """Optional typed references over all tables; never part of a verdict."""
    tables = _tables(spark, sf)
    return R.strict_tallies(R.declared_refs(tables), R.ids_of(tables)).groupBy("pack", "rule").agg(F.sum("n").alias("n"))


@query("""select 'w'||(conv_id%5) pack, 'hook_urgency' as rule, role as value, count(*) n from conversations where role<>'' group by 1, 3
 union all select 'w'||(conv_id%5), 'arc_type', 'detour', count(*) from conversations where turn=0 and conv_id%3=2 group by 1""")
def nested_domains(spark, sf):
    """Urgencies that are roles, and a third of the arcs of an unknown type."""
    turns = T.table(spark, sf, "conversations")
    kind = F.element_at(F.array(F.lit("main"), F.lit("side"), F.lit("detour")), (F.col("conv_id") % 3 + 1).cast("int"))
    arcs, hooks = F.when(F.col("turn") == 0, F.array(F.struct(kind.alias("type")))), F.array(F.struct(F.col("role").alias("urgency")))
    story = turns.select(F.concat(F.lit("w"), (F.col("conv_id") % 5).cast("string")).alias("pack"), arcs.alias("arcs"), hooks.alias("hooks"))
    return R.nested_domains(story).groupBy("pack", "rule", "value").agg(F.count("*").alias("n"))


@query(_BASE + "select pack||'/'||rel path, rel from d")
def relative_paths(spark, sf):
    return with_rel(T.docs(spark, sf).select("root", "path")).select("path", "rel")


@query(_BASE + "select pack, k \"key\", count(*) n from f group by 1, 2")
def top_entries(spark, sf):
    """How often each top-level key occurs."""
    return rules.fields_table(T.docs(spark, sf)).groupBy("pack", "key").agg(F.count("*").alias("n"))


@query("""select 'w'||(o_orderkey%5) pack, case o_orderkey%10 when 3 then 'not_mapping' else 'decode_error' end status, count(*) n from orders where o_orderkey%10 in (3, 4) group by 1, 2""")
def rejected_documents(spark, sf):
    """Orders of which one in five can't be read as a mapping."""
    docs = T.entity_docs(spark, sf, "orders")
    last = F.substring("rel", -6, 1)
    status = F.when(last == "3", "not_mapping").when(last == "4", "decode_error").otherwise("ok")
    return rules.rejects(docs.withColumn("parse_status", status)).groupBy("pack", F.col("parse_status").alias("status")).agg(F.count("*").alias("n"))


@query("""with t as (select 'w'||(p_partkey%5) pack, 'items' as "table", p_partkey k, 1 n from part
  union all select 'w'||(l_orderkey%5), 'scene_objects', l_orderkey, 1 from lineitem union all select 'w'||(l_orderkey%5), 'loot_lines', l_orderkey, 1 from lineitem)
 select "table", pack, count(*) n from t where pack not in ('w1', 'w3') or "table" <> 'loot_lines' and k%2=0 group by 1, 2""")
def replace_by_pack(spark, sf):
    """Two loads: all packs, then w1 and w3 anew with every other entity and without any loot."""
    path = new_path(spark, "loaded")
    tables = _tables(spark, sf, "items", "scene_objects")
    tables |= {"loot_lines": L.child_tables(tables)["loot_lines"]}
    packs = tables["items"].select("pack").distinct()
    L.load_packs(tables, packs, path)
    even = F.regexp_extract("id", r"^[io](\d+)", 1).cast("bigint") % 2 == 0
    again = {"items": tables["items"].filter(even), "scene_objects": tables["scene_objects"].filter(even), "loot_lines": tables["loot_lines"].limit(0)}
    L.load_packs(again, packs.filter("pack in ('w1', 'w3')"), path)
    out = None
    for name, df in tables.items():
        n = L.read_table(spark, path, name, df.schema).groupBy("pack").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "pack", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""with d as (select 'player_characters' kind, c_acctbal >= 0 ok from customer union all select 'actors', s_acctbal >= 0 from supplier)
 select kind, count(*) n from d where ok group by 1""")
def gated_load(spark, sf):
    """Validate, gate and load in one: every customer and supplier as a pack of its own, of which the valid ones are loaded."""
    docs = T.entity_docs(spark, sf, "customer").unionByName(T.entity_docs(spark, sf, "supplier"))
    own = F.concat_ws("/", "pack", "rel")
    v = V.validate(docs.withColumn("pack", own))
    tables = L.typed_tables(L.gate(v.docs, stored(v.summary)))
    kinds = [tables[k].select(F.lit(k).alias("kind"), "id") for k in ("player_characters", "actors")]
    return kinds[0].unionByName(kinds[1]).groupBy("kind").agg(F.count("*").alias("n"))


_WRITTEN = f"""with f as ({_FIELD_ROWS}), d as (select distinct rel, pack, {_TYPE} et from f)
 select et entity_type, case when et = 'scene_objects' and try_cast(regexp_extract(rel, 'o(\\d+)', 1) as bigint) % 10 = 3 then 'not_mapping' when et = 'scene_objects' and try_cast(regexp_extract(rel, 'o(\\d+)', 1) as bigint) % 10 = 4 then 'empty' else 'ok' end parse_status, count(*) n,
  count(*) filter (where exists (select 1 from f where f.pack = d.pack and f.rel = d.rel and f.k = 'name' and f.v <> '') and not (et = 'scene_objects' and try_cast(regexp_extract(rel, 'o(\\d+)', 1) as bigint) % 10 in (3, 4))) named from d group by 1, 2"""


@query(_WRITTEN)
def ingest_roundtrip(spark, sf):
    """All documents of all types written as YAML trees, listed, read and decoded again; of the scene objects a tenth are no mappings and a tenth are empty."""
    out = new_path(spark, "trees").removeprefix("file:")
    last = F.regexp_extract("rel", r"o(\d+)", 1).cast("bigint") % 10
    body = F.coalesce("body", F.lit('{"arcs": [], "hooks": []}'))
    odd = F.when(F.col("entity_type") == "scene_objects", F.when(last == 3, "[1, 2]").when(last == 4, "{}"))
    named = F.count_if(F.exists("fields", lambda f: (f["key"] == "name") & (f["value"] != "")))
    entities = T.docs(spark, sf).select("pack", "rel", F.coalesce(odd, body).alias("body"))
    told = V.through_trees(entities, out, lambda docs: docs.groupBy("entity_type", "parse_status").agg(F.count("*").alias("n"), named.alias("named")))
    return told.groupBy("entity_type", "parse_status").agg(F.sum("n").alias("n"), F.sum("named").alias("named"))


@query("""select 'lore' kind, 'd'||doc_id id, length(text)::bigint n_chars from documents
 union all select 'scenes', 's'||n_nationkey, length('The land of '||n_name) from nation""")
def corpus_rows(spark, sf):
    return L.corpus(_tables(spark, sf, "lore", "scenes")).select("kind", "id", F.length("text").cast("bigint").alias("n_chars"))


@query()
def corpus_vectors(spark, sf):
    """Corpus rows with their vector's number of non-zero entries (no SQL form; tested for unit length and equality)."""
    from pyspark.ml.functions import vector_to_array

    vectors = L.vectorise(L.corpus(_tables(spark, sf, "lore", "scenes")))
    entries = F.size(F.filter(vector_to_array("vector"), lambda x: x != 0))
    return vectors.select("kind", "id", entries.cast("bigint").alias("n_entries"))


@query(_PRESET + """select pack, entity_type, count(*) n, count(*) filter (where run = 2) n_second from (
  select pack, entity_type, rel, case when entity_type='scene_objects' and pos%2=0 and substr(pack,2)::int%3=0 then 2 else 1 end run from e
  union all select 'q'||c_custkey, 'meta', 'meta.yaml', 3 from customer where c_custkey%5=0) group by 1, 2""")
def entity_runs(spark, sf):
    """Three runs merged into one table: all presets, every other scene object of a third of them anew, and other packs."""
    path, key = new_path(spark, "entity-runs"), F.substring("pack", 2, 20).cast("int")
    first = G.expand(T.presets(spark, sf)).withColumn("body", F.lit("1"))
    G.write_entities(first, path, 16)
    G.write_entities(first.filter((F.col("entity_type") == "scene_objects") & (F.col("pos") % 2 == 0) & (key % 3 == 0)).withColumn("body", F.lit("2")), path)
    G.write_entities(first.filter((F.col("entity_type") == "meta") & (key % 5 == 0)).withColumns({"pack": F.concat(F.lit("q"), key.cast("string")), "body": F.lit("3")}), path)
    return G.entity_table(spark, path).read().groupBy("pack", "entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("body") == "2").alias("n_second"))


@query("""with o as (select 'w'||(p_partkey%5) pack, 'i'||p_partkey id, p_partkey%7 k from part)
 select pack, 'items' entity_type, case k when 3 then 'mistyped' when 4 then 'not_mapping' else 'decode_error' end reason, count(*) n, max(case when k = 3 then id end) last_id from o where k in (3, 4, 5) group by 1, 2, 3
 union all select pack, null, 'unclassified', count(*), max(id) from o where k = 6 group by 1""")
def load_rejects(spark, sf):
    """Parts of which four in seven can't be loaded, each for a reason of its own, loaded and read again."""
    k = F.regexp_extract("rel", r"i(\d+)\.yaml", 1).cast("int") % 7
    body = F.when(k == 3, F.to_json(F.struct(F.get_json_object("body", "$.id").alias("id"), F.lit("heavy").alias("weight")))).otherwise(F.col("body"))
    status = F.when(k == 4, "not_mapping").when(k == 5, "decode_error").otherwise("ok")
    docs = T.nested_docs(spark, sf, "items").withColumns({"body": body, "parse_status": status, "entity_type": F.when(k != 6, F.col("entity_type"))})
    path = new_path(spark, "rejected")
    L.load_packs({"items": L.typed_tables(docs)["items"], "rejects": L.load_rejects(docs)}, docs.select("pack"), path)
    rejects = L.read_table(spark, path, "rejects")
    return rejects.groupBy("pack", "entity_type", "reason").agg(F.count("*").alias("n"), F.max(F.get_json_object("content", "$.id")).alias("last_id"))


@query("""with l as (select case when o_custkey%3=0 then 'p0' else 'p'||o_custkey end pack, o_orderkey from orders),
 o as (select pack, o_orderkey, count(*) over (partition by pack) n, count(*) filter (where o_orderkey%3=0) over (partition by pack order by o_orderkey) d from l)
 select pack, o_orderkey::int pos, case when o_orderkey%3<>0 then 'o'||o_orderkey else 'scene_objects_'||(n+d-1) end id from o""")
def named_rows_rerun(spark, sf):
    """Entities as rows, a third of them in one pack, named over the files of a first run."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.when(k % 3 != 0, T.cat("o", k)).alias("id"), F.col("o_orderstatus").alias("name")))
    pack = F.when(F.col("o_custkey") % 3 == 0, F.lit("p0")).otherwise(T.cat("p", F.col("o_custkey")))
    rows = T.table(spark, sf, "orders").select(pack.alias("pack"), F.lit("scene_objects").alias("entity_type"), k.cast("int").alias("pos"), body.alias("body"))
    there = stored(G.named_rows(rows)).select("pack", "entity_type", F.col("id").alias("name"))
    return G.named_rows(rows, there).select("pack", "pos", "id")


@query(_BASE + """select pack, message from own where not (pack = 'w1' and contains(message, ' invalid item_type: ''promo'''))
 union all select pack, rel||' missing: weight' from d where pack = 'w2' and et = 'items'""")
def pack_rules(spark, sf):
    """Rules from tables: the dictionaries' rules, but w1 has item types of its own and w2 wants a weight of its items."""
    required, allowed = rules.rule_tables(spark)
    own = spark.createDataFrame([("w2", "items", i, key) for i, key in enumerate([*REQUIRED["items"], "weight"])], rules.REQUIRED_DDL)
    more = spark.createDataFrame([("w1", "item_type", v) for v in [*ALLOWED["item_type"], "promo"]], rules.ALLOWED_DDL)
    ruled = rules.with_file_errors(T.docs(spark, sf), required.unionByName(own), allowed.unionByName(more))
    return ruled.select("pack", F.explode_outer("file_errors").alias("message")).filter("message is not null")
