"""A corpus pipeline: quality rules, near-duplicates, secrets, source mixture, packing.

Each stage takes all documents its predecessor kept and returns documents again, the last one pieces
of training sequences. Between stages the rows are a Parquet table in the shared folder. No SQL states
the fitted models and the merge ranks of a tokenizer, so there is none for the whole; tests compare
the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.llm import mixing, packing, quality, secrets, simhash
from idsieve.llm.queries import table, vocabulary
from idsieve.llm.shared import written
from idsieve.llm.words import n_words

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs.select("doc_id", "text", "lang", F.struct("*").alias("doc")), quality.fit_references(docs))
    return judged.filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of ``op1``: those linked by SimHash fingerprints that differ in two bits or fewer."""
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    clean = secrets.redact(secrets.scan(docs.select("text", F.struct("*").alias("doc")), secrets.fit(docs)))
    return clean.select("doc.*", F.col("text").alias("clean_text")).select(
        *[F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(c)
          for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; here a document is taken whole or not."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct("*").alias("doc"))
    taken = mixing.take(sized, mixing.Mix(cut_last=False)).filter(F.col("taken") > 0)
    copies = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return taken.select(F.explode(copies), "doc").select("doc.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, each with the sources' proportions."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
    ("source_mixing", source_mixing), ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
