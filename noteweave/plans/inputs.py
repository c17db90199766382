"""Fixture inputs in the table shapes the operators take.

Only reshaping happens here (delimited strings -> arrays); no operator work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import spark_view, table

# Semantic types used by the cohort queries (A1): every fixture type but STANDARD.
COHORT_TYPES = ["PROMO", "ECONOMY", "MEDIUM", "SMALL", "LARGE"]


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 mentions as M9 rows: ``ruled_by`` becomes ``ARRAY<STRING>``."""
    a = spark_view(spark, sf_dir, "f_ann")
    return a.withColumn(
        "ruled_by",
        F.when(F.col("ruled_by") == "", F.array().cast("array<string>"))
        .otherwise(F.split("ruled_by", ",")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "f_doc")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "f_study")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_view(spark, sf_dir, name)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def joined(col: str, sep: str = "|"):
    """Array column -> delimited string (for value comparison with SQL)."""
    return F.array_join(F.col(col), sep).alias(col)
