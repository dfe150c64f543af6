"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import chat, decontaminate, jaccard, licenses, lines, lm, mixing, quality, sharding, spelling, toxicity, trie, urls

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text) -> object:
    return F.coalesce(text, F.lit("")).cast("binary")


URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


SQL["op1_license_scan"] = licenses.oracle()


@query
def op2_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts look like marks."""
    said = F.lit(r"\### Assistant: </turn> ok")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = turns.unionByName(extra)
    return chat.digests(chat.examples(turns))


SQL["op2_chat_prefixes"] = chat.ORACLE


@query
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", (F.octet_length(text_bytes(F.col("text"))) + 1).cast("bigint").alias("size"), F.crc32(text_bytes(F.col("text"))).alias("text_crc32"))
    out = sharding.shard(narrow, 16, tie=F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs).drop("text", "lang")


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source more than twice, every document at least once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("_tie"))
    return mixing.mix(docs, max_repeats=2.0, tokens_col="tokens", tie=F.col("_tie"))


SQL["op5_temperature_mix"] = mixing.ORACLE


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every document."""
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op7_decontamination"] = decontaminate.ORACLE


@query
def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its lines that a near-equal line elsewhere replaces, or an equal one if they are short."""
    docs = table(spark, sf_dir, "documents")
    found = lines.decisions(docs, equal_words=1).withColumnRenamed("doc_id", "_id")
    sizes = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"))
    out = sizes.join(found.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n = F.coalesce(F.size("dropped"), F.lit(0))
    return out.select("doc_id", F.greatest(F.coalesce("n_lines", F.lit(0)), F.lit(0)).alias("n_lines"), F.greatest(n, F.lit(0)).cast("bigint").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), sample=1500, longest=8000).select("doc_id", "held_out", "score", "predicted")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), drop_every=31), times=10)


SQL["op12_spelling_variants"] = spelling.oracle()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    return trie.trie(trie.sequences(trie.rebuilt(turns)))


SQL["op13_prefix_trie"] = trie.oracle(spelling.crc32_sql)
