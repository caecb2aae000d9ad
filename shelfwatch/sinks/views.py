"""The written state and logs in the layout that lists, search, comparison, dashboard and notifications read.

Products are known by the state's product_id, a text. An event's id is made of the batch, shop, product, place and type it
belongs to, so it is the same whenever the log is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.sinks.state import read_log, read_state


def read_products(spark: SparkSession, folder: str) -> DataFrame:
    """The current state with `id` and `current_price`."""
    return read_state(spark, folder).withColumnRenamed("product_id", "id").withColumnRenamed("price", "current_price")


def read_events(spark: SparkSession, folder: str, after: int | None = None) -> DataFrame:
    """Product events and failed scans of all committed batches, or of those above `after`, with `id` and `notification_sent`.

    What was sent is known from the deliveries, so the flag is false here.
    """
    changes = read_log(spark, folder, "events", after)
    failures = read_log(spark, folder, "failures", after)
    for column in ("product_id", "item_ix", "old_value", "new_value"):
        failures = failures.withColumn(column, F.lit(None).cast(changes.schema[column].dataType))
    rows = changes.unionByName(failures.select(*changes.columns))
    key = F.concat_ws("-", "batch", "competitor_id", F.coalesce("product_id", F.lit("")), F.coalesce(F.col("item_ix").cast("string"), F.lit("")), "event_type")
    return rows.withColumns({"id": key, "notification_sent": F.lit(False)})


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The run log with `started_at`; a batch is one point in time."""
    return read_log(spark, folder, "runs").withColumn("started_at", F.col("finished_at"))


def with_scan_status(competitors: DataFrame, runs: DataFrame) -> DataFrame:
    """Competitors with `last_scan_at` and `last_scan_status` of their newest run, null where there was none."""
    newest = runs.groupBy(F.col("competitor_id").alias("id")).agg(
        F.max("finished_at").alias("last_scan_at"), F.max_by("status", "finished_at").alias("last_scan_status")
    )
    return competitors.drop("last_scan_at", "last_scan_status").join(newest, "id", "left")
