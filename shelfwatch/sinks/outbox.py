"""Handing events over as messages, batch after batch, without reading the history again.

    outbox/batch=n/       rendered and paced messages
    deliveries/batch=n/   events that were handed over or suppressed
    waiting/batch=n/      pending events that could not be delivered yet
    clock/batch=n/        when the queue of every webhook ends
    handed/batch=n/       the scan batch up to which events were looked at; written last, it completes the hand-over

What is pending is what waited after the last hand-over, and the events of the scan batches above its mark. A hand-over that died is
done again under its own number. There is one sender at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.notify import new_deliveries, notification_outbox, pending_events, queue_clock
from shelfwatch.session import cut_lineage
from shelfwatch.sinks.state import current_version, newest_complete, read_line, write_line, write_outbox
from shelfwatch.sinks.views import read_events

CLOCK_SCHEMA = "webhook_url string, free_at timestamp"


def last_hand_over(spark: SparkSession, folder: str) -> tuple[int, int] | None:
    """Number of the last complete hand-over, and the scan batch it had come to."""
    name = newest_complete(spark, f"{folder}/handed")
    return None if name is None else (int(name.removeprefix("batch=")), read_line(spark, f"{folder}/handed/{name}")["upto"])


def read_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Events without a delivery: those of new scan batches, and those that waited."""
    last = last_hand_over(spark, folder)
    if last is None:
        return pending_events(read_events(spark, folder))
    fresh = read_events(spark, folder, after=last[1])
    waiting = spark.read.schema(fresh.schema).parquet(f"{folder}/waiting/batch={last[0]}")
    return pending_events(fresh.unionByName(waiting))


def read_clock(spark: SparkSession, folder: str) -> DataFrame:
    last = last_hand_over(spark, folder)
    if last is None:
        return spark.createDataFrame([], CLOCK_SCHEMA)
    return spark.read.schema(CLOCK_SCHEMA).parquet(f"{folder}/clock/batch={last[0]}")


def hand_over(
    spark: SparkSession, folder: str, initial: DataFrame, competitors: DataFrame, products: DataFrame, now, default_webhook: str | None = None,
    enabled: bool = True, backlog_limit: int | None = None,
) -> DataFrame:
    """Render, pace and write the messages of all pending events, and return them. Switched off, everything goes on waiting."""
    last, upto = last_hand_over(spark, folder), current_version(spark, folder)
    number = 0 if last is None else last[0] + 1
    clock = read_clock(spark, folder)
    pending = cut_lineage(read_pending(spark, folder))
    outbox = cut_lineage(notification_outbox(pending, initial, competitors, products, now, default_webhook, enabled, backlog_limit, clock))
    deliveries = new_deliveries(pending, initial, outbox, now, backlog_limit)
    write_outbox(outbox, deliveries if enabled else deliveries.limit(0), folder, number)
    done = spark.read.parquet(f"{folder}/deliveries/batch={number}")
    pending_events(pending, done).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
    queue_clock(outbox, now, clock).select(F.col("webhook_url"), F.col("free_at").cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/clock/batch={number}")
    write_line(spark, f"{folder}/handed/batch={number}", {"upto": -1 if upto is None else upto})
    return outbox
