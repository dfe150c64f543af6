"""Column helpers over the ``fields`` array of a document and over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom.schemas import REQUIRED


def field_sql(pos: int, key: str, value: str, kind: str = "str") -> str:
    """SQL of one entry of ``fields``; a null value gets kind ``null``, lists and mappings carry no value."""
    if kind in ("seq", "map"):
        kind_sql, text, truthy = f"'{kind}'", "cast(null as string)", "true"
    else:
        empty = "''" if kind == "str" else "'', '0', '0.0', 'False'"
        kind_sql, text = f"if({value} is null, 'null', '{kind}')", f"cast({value} as string)"
        truthy = f"coalesce({text}, '') not in ({empty})"
    return f"named_struct('pos', {pos}, 'key', '{key}', 'kind', {kind_sql}, 'value', {text}, 'truthy', {truthy})"


def get_field(key: str, fields: Column | str = "fields") -> Column:
    """The entry named ``key``, null when absent."""
    return F.get(F.filter(F.col(fields) if isinstance(fields, str) else fields, lambda f: f["key"] == key), F.lit(0))


def entity_type(rel: Column, order=tuple(REQUIRED)) -> Column:
    """First type, in rule order, whose name occurs anywhere in the relative path."""
    out = None
    for name in order:
        hit = rel.contains(F.lit(name))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def id_key(field: Column) -> Column:
    """Equality key of a scalar: numbers and booleans compare by value, never with strings."""
    kind, value = field["kind"], field["value"]
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
    return (
        F.when(kind == "str", F.concat(F.lit("s:"), value))
        .when(kind == "bool", F.when(value == "True", "n:1").otherwise("n:0"))
        .when(kind == "int", F.concat(F.lit("n:"), value))
        .when(kind == "float", F.concat(F.lit("n:"), F.when(whole, number.cast("bigint").cast("string")).otherwise(value)))
        .when(kind == "date", F.concat(F.lit("d:"), value))
    )
