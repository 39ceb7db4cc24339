"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import delete, tables, written  # noqa: F401  the operators take them from here

#: White space that separates words in every operator contract: space and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Words of a text column as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def wide(spark: SparkSession) -> int:
    """Partitions for a shuffle of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
