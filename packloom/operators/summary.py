"""Errors, tallies, verdicts and reports of a validation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions.running import numbered
from packloom.keyed import BUCKETS, Keyed
from packloom.operators.refs import few, orphans
from packloom.operators.rules import with_file_errors
from packloom.storage import stored


def checked(docs: DataFrame) -> DataFrame:
    """pack, rel and file_errors of every document.  Store it where it's used more than once."""
    return with_file_errors(docs).select("pack", "rel", "file_errors")


def ordered_errors(docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """pack, stage (0: of single documents, 1: of references), rel, pos and message of every error; duplicates stay.

    By pos, a document's missing keys come first, in the order of the rules, and then its
    values, in the order of the document.
    """
    # An outer explode and a filter on the message: else Spark puts the size of the list, and so the rules once more, into a filter below.
    own = (checked(docs) if own is None else own).select("pack", F.lit(0).alias("stage"), "rel", F.posexplode_outer("file_errors").alias("pos", "message"))
    cross = orphans(docs).select("pack", F.lit(1).alias("stage"), "rel", "pos", "message")
    return own.filter("message is not null").unionByName(cross)


def all_errors(docs: DataFrame) -> DataFrame:
    """Error rows: stage 0 of single documents, stage 1 of references; duplicates stay."""
    return ordered_errors(docs).select("pack", "stage", "message")


def prefixes(cross: DataFrame) -> DataFrame:
    """Distinct message prefixes, up to the first colon, of reference errors: pack, prefix."""
    return cross.select("pack", F.substring_index("message", ":", 1).alias("prefix")).distinct()


def crossref_failures(errors: DataFrame) -> DataFrame:
    return prefixes(errors.filter("stage = 1")).groupBy("pack").agg(F.count("*").alias("n"))


def file_tally(docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    ok = F.size("file_errors") == 0
    return (checked(docs) if own is None else own).groupBy("pack").agg(F.count_if(ok).alias("ok_files"), F.count_if(~ok).alias("bad_files"))


def verdicts(tally: DataFrame) -> DataFrame:
    """pack, passed, failed and is_valid from ok_files, bad_files and n (reference prefixes), null for none."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = tally.select("pack", zero("ok_files").alias("passed"), (zero("bad_files") + zero("n")).alias("failed"))
    return out.withColumn("is_valid", F.col("failed") == 0)


def pack_summary(docs: DataFrame, errors: DataFrame | None = None, packs: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """passed, failed and verdict per pack.

    ``failed`` adds failing documents and reference prefixes, so a document can count
    twice.  ``packs`` (pack) adds requested packs without any document: they are valid.
    ``errors`` and ``own`` (``checked``) spare finding them again.
    """
    cross = prefixes(orphans(docs)).groupBy("pack").agg(F.count("*").alias("n")) if errors is None else crossref_failures(errors)
    tally = file_tally(docs, own)
    if packs is not None:
        tally = packs.select("pack").distinct().join(tally.hint("shuffle_merge"), "pack", "left")
    return verdicts(tally.join(cross.hint("shuffle_merge"), "pack", "left"))


def report_rows(errors: DataFrame, summary: DataFrame) -> DataFrame:
    """The lines of all reports as rows: pack, part, rel, pos and line.

    Parts: 0 errors of single documents, 1 errors of references, 2 the rule of 50 dashes,
    3 the counts.  Sorted by part, rel and pos, a pack's rows are its report.  A pack's errors
    are never gathered, so it may have any number of them; repeated messages stay.
    """
    own = errors.select("pack", F.col("stage").alias("part"), "rel", "pos", F.concat(F.lit("  "), "message").alias("line"))
    counts = F.concat(F.col("passed").cast("string"), F.lit(" passed, "), F.col("failed").cast("string"), F.lit(" failed"))
    ends = F.array(F.struct(F.lit(2).alias("part"), F.lit("-" * 50).alias("line")), F.struct(F.lit(3).alias("part"), counts.alias("line")))
    last = summary.select("pack", F.explode(ends).alias("e")).select("pack", "e.part", F.lit("").alias("rel"), F.lit(0).alias("pos"), "e.line")
    return own.unionByName(last)


def report_lines(errors: DataFrame, summary: DataFrame) -> DataFrame:
    """All reports with the lines numbered from 1: pack, no and line.  A pack's lines spread over tasks."""
    return numbered(report_rows(errors, summary), ["pack"], ["part", "rel", "pos"], "no").select("pack", "no", "line")


class Tallies:
    """Tallies that are kept: a changed pack's counts and prefixes are replaced, and no other pack is looked at.

    One keyed table has a row with both counts for each pack (prefix null) and a row for each of its reference prefixes.
    """

    def __init__(self, spark, path: str, buckets: int = BUCKETS):
        self.table = Keyed(spark, path, ["pack", "prefix"], buckets)

    def replace(self, packs: DataFrame, docs: DataFrame) -> None:
        """Put these packs' state (pack) in place of theirs, from their documents; a pack without documents stays as an empty one."""
        names = stored(packs.select("pack").distinct())
        # Of few packs each may have very many prefixes, so these aren't dealt out by pack.
        how = "broadcast" if few(names) else "shuffle_merge"
        none, zero = F.lit(None).cast("string").alias("prefix"), F.lit(0).cast("bigint")
        counts = names.join(file_tally(docs).hint("shuffle_merge"), "pack", "left").select("pack", none, F.coalesce("ok_files", zero).alias("ok"), F.coalesce("bad_files", zero).alias("bad"))
        cross = prefixes(orphans(docs)).select("pack", "prefix", zero.alias("ok"), zero.alias("bad"))
        new, old = stored(counts.unionByName(cross.join(names.hint(how), "pack", "left_semi"))), self.table.read()
        if old is None:
            self.table.merge(new)
            return
        theirs = old.join(names.hint(how), "pack", "left_semi").select("pack", "prefix")
        same = [theirs[c].eqNullSafe(F.col(f"_{c}")) for c in ("pack", "prefix")]
        kept = new.select(F.col("pack").alias("_pack"), F.col("prefix").alias("_prefix"))
        self.table.merge(new, theirs.join(kept.hint("shuffle_merge"), same, "left_anti"))

    def summary(self) -> DataFrame:
        """``pack_summary`` of all packs."""
        return verdicts(self.table.read().groupBy("pack").agg(F.sum("ok").alias("ok_files"), F.sum("bad").alias("bad_files"), F.count("prefix").alias("n")))
