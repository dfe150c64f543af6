"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of words; windows start every half window, so whatever lies within half
a window lies whole in some block.  Half a window is a power of two that holds the template
whole, so a notice of one line and a full license text are each compared with blocks of
about their own size.  A block meets a template when it holds at least ``threshold`` of the
template's distinct words.

The join is exact.  Words are ordered by how many documents hold them, rarest first.  Two
sets that share enough words share one among their first few, so the template words that
can be the first shared one (prefix) are indexed, and only blocks that hold an indexed word
are made and looked up: what the index gives for a block's own prefix words are its
candidates.  A candidate is dropped if the block is too small (length) or if the
words left after the first shared one can't suffice (position); the rest are counted.
Words outside all templates can't match and are left out of the blocks beforehand.

Templates and their index are constants of the plan: no row leaves its task, and no
document, source or group of copies can be hot.  Their number and length are free; the
plan grows with their distinct words.  Null and empty texts have no words and no labels; a
text of any length is cut into windows in its task.  Repeated rows get equal results, an
empty table gives none, and ties in the order go by the word.  Input columns named like an
added one are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase, label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices of common licenses, label and text.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other"
        " liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with"
        " regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special"
        " direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract"
        " negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"
        " and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or"
        " implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
]
#: Half a window holds at least so many words.
LEAST_HALF = 32
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null counts as empty.  For texts in ASCII, ``lower`` does the same faster."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))


def tokens(template: str) -> list[str]:
    return sorted(set(re.findall(WORD, template.lower())))


def word_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first; counted over all documents.

    What reaches the driver is one count per template word.
    """
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words_of(F.col(text_col)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def least_overlap(size: int, threshold: float) -> int:
    """Smallest overlap o with o >= threshold * size."""
    return max(1, -int(-round(threshold * size * 1e9) // 10**9))


def _strings(values: list[str]) -> str:
    return "array(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def by_size(templates: list[tuple[str, str]]) -> dict[int, list[tuple[str, list[str]]]]:
    """Templates as (label, distinct words) by half a window, a power of two that holds them whole."""
    out: dict[int, list[tuple[str, list[str]]]] = {}
    for label, text in templates:
        n = len(re.findall(WORD, text.lower()))
        out.setdefault(max(LEAST_HALF, 1 << max(0, n - 1).bit_length()), []).append((label, tokens(text)))
    return dict(sorted(out.items()))


def _met(half: int, sets: list[tuple[str, list[str]]], rank: dict[str, int], threshold: float) -> str:
    """SQL of the verified (label, score) of all blocks of ``_w`` with templates of one size."""
    listed, index = [], {}
    for number, (label, ws) in enumerate(sets, 1):
        ws = sorted(ws, key=rank.get)
        need = least_overlap(len(ws), threshold)
        for w in ws[: len(ws) - need + 1]:
            index.setdefault(w, []).append(number)
        listed.append(f"named_struct('label','{label}','need',{need},'prefix',{_strings(ws[: len(ws) - need + 1])},'words',{_strings(ws)})")
    rare, order = sorted(index, key=rank.get), sorted({w for _, ws in sets for w in ws}, key=rank.get)
    least = min(least_overlap(len(ws), threshold) for _, ws in sets)
    hit = f"array_contains({_strings(rare)}, w)"
    near = f"transform(filter(transform(_w, (w, i) -> if({hit}, i, -1)), i -> i >= 0), i -> i div {half})"
    blocks = f"array_distinct(flatten(transform({near}, b -> if(b > 0, array(b - 1, b), array(b)))))"
    sets_of = f"transform({blocks}, b -> array_intersect({_strings(order)}, slice(_w, cast(b * {half} + 1 as int), {2 * half})))"
    large = f"filter({sets_of}, b -> size(b) >= {least})"
    entries = ", ".join(f"'{w}', array({', '.join(map(str, ns))})" for w, ns in index.items())
    found = f"array_distinct(flatten(transform(array_intersect({_strings(rare)}, b), w -> element_at(map({entries}), w))))"
    first = "element_at(array_intersect(t.prefix, slice(b, 1, size(b) - t.need + 1)), 1)"
    left = f"least(size(t.words) - array_position(t.words, {first}), size(b) - array_position(b, {first})) + 1"
    qualifies = f"size(b) >= t.need and size(array_intersect(t.prefix, slice(b, 1, size(b) - t.need + 1))) > 0 and {left} >= t.need"
    candidates = f"filter(transform({found}, n -> element_at(array({','.join(listed)}), n)), t -> {qualifies})"
    overlap = "size(array_intersect(t.words, b))"
    counted = f"transform({candidates}, t -> named_struct('label', t.label, 'need', t.need, 'n', {overlap}, 'score', {overlap} / size(t.words)))"
    verified = f"flatten(transform({large}, b -> filter({counted}, m -> m.n >= m.need)))"
    none = "cast(array() as array<struct<label:string,need:int,n:int,score:double>>)"
    return f"if(arrays_overlap(_w, {_strings(rare)}), {verified}, {none})"


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """Add n_words; n_base, first_word, last_word and base_labels of the phrases' places; labels with the
    templates' added; and score, the highest containment among verified blocks, 1 with a phrase alone, else 0."""
    sized = by_size(templates)
    vocabulary = sorted({w for sets in sized.values() for _, ws in sets for w in ws})
    rank = {w: i for i, w in enumerate(word_order(docs, text_col, vocabulary))}
    names = [c for c in docs.columns if c not in ADDED]
    base = docs.select(*names, words_of(F.col(text_col)).alias("_w"))

    # Places of the phrases, by label.
    ends = sorted({p.split()[-1] for p, _ in phrases})
    places = []
    for phrase, label in phrases:
        parts = phrase.split()
        match = " and ".join(f"get(_w, i + {k}) <=> '{p}'" for k, p in enumerate(parts))
        places.append(f"transform(filter(_at, i -> {match}), i -> named_struct('at', i, 'label', '{label}'))")
    heads = sorted({p.split()[0] for p, _ in phrases})
    is_head = " or ".join(f"w = '{h}'" for h in heads)
    maybe = f"arrays_overlap(_w, {_strings(ends)})"
    starts = f"if({maybe}, filter(transform(_w, (w, i) -> if({is_head}, i, -1)), i -> i >= 0), cast(array() as array<int>))"
    found = base.withColumn("_at", F.expr(starts)).withColumn("_base", F.expr(f"concat({', '.join(places)})"))
    met = ", ".join(_met(half, sets, rank, threshold) for half, sets in sized.items())
    found = found.withColumn("_met", F.expr(f"concat({met})"))

    join = lambda a: f"array_join(array_sort(array_distinct({a})), ',')"
    return found.select(
        *names,
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr("cast(size(_base) as bigint)").alias("n_base"),
        F.expr("cast(array_min(_base.at) as bigint)").alias("first_word"),
        F.expr("cast(array_max(_base.at) as bigint)").alias("last_word"),
        F.expr(join("_base.label")).alias("base_labels"),
        F.expr(join("concat(_base.label, _met.label)")).alias("labels"),
        F.expr("coalesce(array_max(_met.score), if(size(_base) > 0, 1.0D, 0.0D))").alias("score"),
    )


def oracle(templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> str:
    """The same result in SQL, by comparing every block with every template of its size."""
    rows = [(half, label, ws, least_overlap(len(ws), threshold)) for half, sets in by_size(templates).items() for label, ws in sets]
    values = ", ".join(f"({half}, '{label}', [{', '.join(map(repr, ws))}], {need})" for half, label, ws, need in rows)
    halves = ", ".join(f"({half})" for half in by_size(templates))
    found = " union all ".join(
        f"select doc_id, i - 1 place, '{label}' label from w, unnest(range(1, len(ws) + 1)) t(i) where "
        + " and ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in phrases
    )
    return f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
 p as ({found}),
 pa as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word from p group by 1),
 t(half, label, ts, need) as (values {values}),
 h(half) as (values {halves}),
 b as (select doc_id, half, list_distinct(ws[k * half + 1 : k * half + 2 * half]) bs from w, h, unnest(range(0, greatest(1, (len(ws) + half - 1) // half))) u(k)),
 m as (select doc_id, label, len(list_intersect(bs, ts)) / len(ts) score from b join t using (half) where len(list_intersect(bs, ts)) >= need),
 ms as (select doc_id, max(score) score from m group by 1),
 bl as (select doc_id, string_agg(label, ',' order by label) l from (select distinct doc_id, label from p) group by 1),
 al as (select doc_id, string_agg(label, ',' order by label) l from (select doc_id, label from p union select doc_id, label from m) group by 1)
 select w.doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(bl.l, '') base_labels, coalesce(al.l, '') labels, coalesce(ms.score, case when n_base > 0 then 1.0 else 0.0 end)::double score
 from w left join pa using (doc_id) left join ms using (doc_id) left join bl using (doc_id) left join al using (doc_id)"""
