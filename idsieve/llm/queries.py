"""The registered queries of the subpackage: each operator over its whole table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.llm import divergence, forest, language, middle, mixing, neighbours, packing, pages, quality, secrets, simhash, suffixes, tokens
from idsieve.llm.shared import checkpointed
from idsieve.llm.words import n_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, quality.fit_references(docs)).drop("text", "lang")


@query("op8_source_mixing", mixing.ORACLE_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.take(checkpointed(sizes)).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_secret_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in secrets.SHAPES],
        F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listed(F.concat("base_spans", "added_spans")).alias("spans"))


def vocabulary() -> str:
    """The vocabulary file that the queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"), vocabulary())


@query("op3_mixture_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary())


@query("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, profiles).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_page_text")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op1_simhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.groups(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("p0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query("op2_nearest_vectors")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.search(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


@query("op5_repeated_passages")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.remove(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_fill_in_middle", middle.ORACLE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = middle.transform(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_source_divergence", divergence.ORACLE_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


@query("op12_minhash_forest")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = forest.groups(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
