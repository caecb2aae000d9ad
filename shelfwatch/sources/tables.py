"""Stored tables: parquet in, column pruning and filters left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed page documents (JSON, HTML, XML), one whole file per row: doc_url and body."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_url"), F.col("value").alias("body"))


def list_competitors(competitors: DataFrame, active_only: bool = False) -> DataFrame:
    """All or only the active competitors. The caller orders: newest first is `newest_first`."""
    return competitors.where("active") if active_only else competitors


def newest_first(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_first(), F.col("id").desc())


def with_competitor(df: DataFrame, competitors: DataFrame, *columns: str) -> DataFrame:
    """Rows with the name of their competitor (and more of its columns).

    The competitor table grows with the number of shops, so no broadcast is forced: Catalyst broadcasts it when its
    size statistics allow, otherwise AQE splits the partitions of a shop that owns a large share of the rows.
    """
    names = competitors.select(
        F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"), *columns
    )
    return df.join(names, "competitor_id")
