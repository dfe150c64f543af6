"""Per-document rules: missing keys and values outside their domain.  No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.schemas import ALLOWED, REQUIRED
from packloom.storage import stored


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(map(_text, values))


def missing_messages(required: dict[str, list[str]] = REQUIRED) -> Column:
    """A key is missing when absent, null or the empty string; empty lists and zero are present."""
    cases = " ".join(f"when {_text(kind)} then array({_list(keys)})" for kind, keys in required.items())
    keys = f"coalesce(case entity_type {cases} end, cast(array() as array<string>))"
    present = "exists(fields, f -> f.key = k and f.kind <> 'null' and not (f.kind = 'str' and f.value = ''))"
    return F.expr(f"transform(filter({keys}, k -> not {present}), k -> concat(rel, ' missing: ', k))")


def invalid_messages(allowed: dict[str, list[str]] = ALLOWED) -> Column:
    """Any top-level non-empty string under a ruled key that its list doesn't hold, in document order."""
    outside = " or ".join(f"(f.key = {_text(key)} and f.value not in ({_list(values)}))" for key, values in allowed.items())
    bad = f"f.kind = 'str' and f.value <> '' and ({outside or 'false'})"
    return F.expr(f"transform(filter(fields, f -> {bad}), f -> concat(rel, ' invalid ', f.key, ': \\'', f.value, '\\''))")


#: Rules given as tables: which keys a type must have, by pos, and which values a key may have.  A null pack means all packs that have no rules of their own for that type or key.
REQUIRED_DDL, ALLOWED_DDL = "pack string, entity_type string, pos int, key string", "pack string, key string, value string"
#: So many rule rows at most become part of the plan; of more, up to so many grouped rules are sent to all tasks.
LITERAL_RULES, BROADCAST_RULES = 500, 100_000


def rule_tables(spark, required: dict[str, list[str]] = REQUIRED, allowed: dict[str, list[str]] = ALLOWED) -> tuple[DataFrame, DataFrame]:
    """The dictionaries as tables, to add rows to."""
    keys = [(None, kind, i, key) for kind, names in required.items() for i, key in enumerate(names)]
    values = [(None, key, value) for key, many in allowed.items() for value in many]
    return spark.createDataFrame(keys, REQUIRED_DDL), spark.createDataFrame(values, ALLOWED_DDL)


def _literal(rows: list, value) -> Column:
    """A map literal from (pack, name) to a list of texts; a null pack is the pack "" with a mark of its own."""
    if not rows:
        return F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[c for r in rows for c in (F.lit(_at(r.pack, r.name)), F.array(*map(F.lit, value(r))))])


def _at(pack: str | None, name: str) -> str:
    return f"*\x00{name}" if pack is None else f"={pack}\x00{name}"


def with_rules(docs: DataFrame, required: DataFrame, allowed: DataFrame) -> DataFrame:
    """Add ``_required`` (keys of the document's type, in order) and ``_allowed`` (values by key) from rule tables.

    A pack's rules for a type or key replace those of null pack.  Repeated rows count once.
    Few rules become literals of the plan.  More are joined: grouped by pack and type, and by pack, and
    sent to all tasks if they are few (counted), else shuffled.
    """
    keys = required.filter("entity_type is not null and key is not null").groupBy("pack", F.col("entity_type").alias("name")).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "key"))).alias("keys"))
    keys = keys.select("pack", "name", F.array_distinct(F.transform("keys", lambda k: k["key"])).alias("list"))
    values = allowed.filter("key is not null and value is not null").groupBy("pack", F.col("key").alias("name")).agg(F.array_sort(F.collect_set("value")).alias("list"))
    if required.limit(LITERAL_RULES + 1).count() + allowed.limit(LITERAL_RULES + 1).count() <= LITERAL_RULES:
        must, may = keys.collect(), values.collect()
        own, all_ = F.concat(F.lit("="), "pack", F.lit("\x00"), "entity_type"), F.concat(F.lit("*\x00"), "entity_type")
        by_type = _literal(must, lambda r: r.list)
        found = F.coalesce(F.try_element_at(by_type, own), F.try_element_at(by_type, all_), F.array().cast("array<string>"))
        packs = sorted({r.pack for r in may if r.pack is not None})
        plain = {r.name: r.list for r in may if r.pack is None}

        def lists(pack):
            ruled = plain | {r.name: r.list for r in may if r.pack == pack}
            return F.create_map(*[c for k, v in ruled.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]) if ruled else F.create_map().cast("map<string,array<string>>")

        told = None
        for pack in packs:
            told = F.when(F.col("pack") == pack, lists(pack)) if told is None else told.when(F.col("pack") == pack, lists(pack))
        return docs.withColumns({"_required": found, "_allowed": lists(None) if told is None else told.otherwise(lists(None))})
    keys, grouped = stored(keys), stored(values.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("name", "list"))).alias("lists")))
    how = lambda df: "broadcast" if df.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else "shuffle_merge"
    every, own = keys.filter("pack is null").select(F.col("name").alias("entity_type"), F.col("list").alias("_every")), keys.filter("pack is not null").select("pack", F.col("name").alias("entity_type"), F.col("list").alias("_own"))
    own_lists = grouped.filter("pack is not null").select("pack", F.col("lists").alias("_lists"))
    out = docs.join(every.hint(how(every)), "entity_type", "left").join(own.hint(how(own)), ["pack", "entity_type"], "left").join(own_lists.hint(how(own_lists)), "pack", "left")
    plain = grouped.filter("pack is null").select(F.col("lists").alias("_plain"))  # one row at most
    out = out.withColumn("_one", F.lit(1)).join(plain.withColumn("_one", F.lit(1)).hint("broadcast"), "_one", "left")
    none = F.create_map().cast("map<string,array<string>>")
    both = F.map_concat(F.map_filter(F.coalesce("_plain", none), lambda k, _: ~F.map_contains_key(F.coalesce("_lists", none), k)), F.coalesce("_lists", none))
    return out.withColumns({"_required": F.coalesce("_own", "_every", F.array().cast("array<string>")), "_allowed": both}).select(*docs.columns, "_required", "_allowed")


def _table_messages() -> Column:
    present = "exists(fields, f -> f.key = k and f.kind <> 'null' and not (f.kind = 'str' and f.value = ''))"
    bad = "f.kind = 'str' and f.value <> '' and not array_contains(coalesce(try_element_at(_allowed, f.key), array(f.value)), f.value)"
    return F.concat(
        F.expr(f"transform(filter(_required, k -> not {present}), k -> concat(rel, ' missing: ', k))"),
        F.expr(f"transform(filter(fields, f -> {bad}), f -> concat(rel, ' invalid ', f.key, ': \\'', f.value, '\\''))"),
    )


def with_file_errors(docs: DataFrame, required=REQUIRED, allowed=ALLOWED) -> DataFrame:
    """Add ``file_errors``: missing-key messages, then domain messages; none for unclassified documents.

    Rules are dictionaries, or tables (both of ``REQUIRED_DDL`` and ``ALLOWED_DDL``) that may hold rules of single packs.

    A classified document that isn't a mapping, or any that can't be decoded, gets one
    message of its own instead, so that one bad file fails alone and not the whole job.
    """
    none = F.array().cast("array<string>")
    broken = (F.col("parse_status") == "decode_error") | ((F.col("parse_status") == "not_mapping") & F.col("entity_type").isNotNull())
    if isinstance(required, DataFrame):
        docs, checked = with_rules(docs, required, allowed), _table_messages()
    else:
        checked = F.concat(missing_messages(required), invalid_messages(allowed))
    out = docs.withColumn(
        "file_errors",
        F.when(broken, F.array(F.concat(F.col("rel"), F.lit(" unreadable: "), F.col("parse_status"))))
        .when(F.col("entity_type").isNull(), none)
        .otherwise(checked),
    )
    return out.drop("_required", "_allowed")


def file_status(docs: DataFrame) -> DataFrame:
    """One row per document: whether it has no error of its own."""
    return with_file_errors(docs).select("pack", "rel", (F.size("file_errors") == 0).alias("ok"))


def rejects(docs: DataFrame) -> DataFrame:
    """Documents whose content can't be read as a mapping."""
    return docs.filter(F.col("parse_status").isin("not_mapping", "decode_error"))


def fields_table(docs: DataFrame) -> DataFrame:
    """Top-level entries as rows, in document order."""
    return docs.select("pack", "rel", F.explode("fields").alias("f")).select("pack", "rel", "f.*")
