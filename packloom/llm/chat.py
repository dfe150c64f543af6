"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example's text is the conversation up to and including that turn; only the turn's
text is under the loss mask (``loss_start`` to ``loss_end``, in characters).  A
conversation that doesn't end in an assistant turn has one more example, the whole
conversation with nothing under the mask, so that no turn is lost.

A turn is written ``<turn role>text</turn>`` and a line feed.  Inside texts, a ``~`` is put
into whatever looks like a mark (``<turn``, ``</turn``, and those already holding ``~``),
and taken out again on reading; other texts stay as they are.

Turns are ordered by turn, then role and text where turns repeat; null turns come first.
Null texts and roles count as empty.  A null conversation id is a conversation.  Other
columns are left out.  An empty table gives no examples.  One conversation is one row while
it is formatted, as its transcript is one text, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<(~*/?turn)", "<~$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<~(~*/?turn)", "<$1")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), (">", "%3E"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%3E", ">"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def examples(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, example (number within the conversation), target_turn (place of the target, null without one),
    text, loss_start, loss_end, is_last (the example that holds all turns)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit(">"))
    piece = F.struct(
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.concat(head, escape(text), F.lit(CLOSE)).alias("piece"),
        F.char_length(head).alias("head"),
    )
    talks = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    talks = talks.select("conv_id", "p", F.array_join("p.piece", "").alias("whole"))
    # Running ends of the turns, as an array one longer than the turns.
    ends = "aggregate(p, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + char_length(x.piece))))"
    talks = talks.withColumn("ends", F.expr(ends))
    n = "size(p)"
    targets = f"filter(transform(p, (x, i) -> if(x.role = 'assistant' or i = {n} - 1, i, -1)), i -> i >= 0)"
    rows = talks.select("conv_id", "p", "whole", "ends", F.expr(f"posexplode({targets})").alias("example", "i"))
    answered = "element_at(p, i + 1).role = 'assistant'"
    start, end = "element_at(ends, i + 1) + element_at(p, i + 1).head", f"element_at(ends, i + 2) - {len(CLOSE)}"
    return rows.select(
        "conv_id",
        "example",
        F.expr(f"if({answered}, i, null)").alias("target_turn"),
        F.expr("if(i = size(p) - 1, whole, left(whole, element_at(ends, i + 2)))").alias("text"),
        F.expr(f"if({answered}, {start}, 0)").alias("loss_start"),
        F.expr(f"if({answered}, {end}, 0)").alias("loss_end"),
        F.expr("i = size(p) - 1").alias("is_last"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example's text: array of (role, text), unescaped."""
    marks = F.slice(F.split(text, CLOSE), F.lit(1), F.size(F.split(text, CLOSE)) - 1)
    return F.transform(
        marks,
        lambda m: F.struct(
            unescape_role(F.substring_index(F.substr(m, F.lit(len(OPEN) + 1)), ">", 1)).alias("role"),
            unescape(F.substr(m, F.instr(m, ">") + 1)).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.substr(text, start + 1, end - start))


def digests(formatted: DataFrame) -> DataFrame:
    """Read examples back: per conversation its turns' number and digest, what the loss covers, and all characters written."""
    turns = read_turns(F.col("text"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(
        "conv_id",
        F.when(F.col("is_last"), F.size(turns)).cast("bigint").alias("n"),
        F.when(F.col("is_last"), F.sha2(told.cast("binary"), 256)).alias("sha"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("t")).alias("loss"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.array_sort(F.collect_list("loss"))["t"], "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


ORACLE = r"""with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 s as (select *, 6 + length(replace(replace(replace(role, '%', '%25'), '>', '%3E'), '<', '%3C')) + 1 + length(regexp_replace(text, '<(~*/?turn)', '<~\1', 'g')) + 8 as width,
   row_number() over (partition by conv_id order by turn desc) back from c),
 e as (select *, sum(width) over (partition by conv_id order by turn) upto from s)
 select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) loss_sha256,
  (sum(upto) filter (where role = 'assistant' or back = 1))::bigint formatted_chars,
  (count(*) filter (where role = 'assistant' or back = 1))::bigint n_examples
 from e group by 1"""
