"""Document profiles: a nine-row dimension, always small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsieve.functions.common import case
from idsieve.functions.fixed import DOCUMENT_TYPES, PROFILES, SUBTYPE_CATEGORY

SCHEMA = (
    "document_type string, profile_id string, display_name string, "
    "expected_fields array<string>, supports_mrz boolean, category string, type_ord int"
)


def category(label: Column) -> Column:
    """Core category of a type; subtypes fold into theirs, strangers into UNKNOWN."""
    return case(
        *[(label == sub, cat) for sub, cat in SUBTYPE_CATEGORY.items()],
        (label.isin(*DOCUMENT_TYPES), label),
        otherwise="UNKNOWN",
    )


def profiles(spark: SparkSession) -> DataFrame:
    rows = [
        (t, pid, name, list(fields), mrz, SUBTYPE_CATEGORY.get(t, t), DOCUMENT_TYPES.index(t))
        for t, pid, name, fields, mrz in PROFILES
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_profile(docs: DataFrame) -> DataFrame:
    """Left join to the profile; types without one take the UNKNOWN profile."""
    known = F.when(F.col("document_type").isin(*DOCUMENT_TYPES), F.col("document_type"))
    dim = profiles(docs.sparkSession).withColumnRenamed("document_type", "_type")
    return (
        docs.withColumn("_type", F.coalesce(known, F.lit("UNKNOWN")))
        .join(F.broadcast(dim), "_type", "left").drop("_type")
    )
