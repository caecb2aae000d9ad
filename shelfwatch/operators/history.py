"""Replay of a whole observation history: every scan of every competitor at once, without a loop over scans.

Observations hold one row per (competitor_id, product_key, scan_no), so a product's window has at most as many rows as
its competitor has scans: the group is bounded by the scan calendar, not by the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.constants import MISSES_UNTIL_REMOVED
from shelfwatch.functions.text import blank_to_null
from shelfwatch.operators.detect import percent, price_event_type, stock_event_type

KEY = ("competitor_id", "product_key")


def scan_calendar(observations: DataFrame) -> DataFrame:
    """(competitor_id, scan_no, s, last_s): scans numbered densely per competitor, and the number of the last one."""
    scans = observations.select("competitor_id", "scan_no").distinct()
    order = Window.partitionBy("competitor_id").orderBy("scan_no")
    return scans.select(
        "competitor_id", "scan_no", F.row_number().over(order).alias("s"),
        F.count("*").over(Window.partitionBy("competitor_id")).cast("int").alias("last_s"),
    )


def replay_sequence(observations: DataFrame) -> DataFrame:
    """Each observation with its predecessor's values and its scan number."""
    order = Window.partitionBy(*KEY).orderBy("scan_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = observations.join(scan_calendar(observations), ["competitor_id", "scan_no"])
    rows = numbered.withColumns({
        "is_first": F.row_number().over(order) == 1,
        "old_price": F.lag("price").over(order),
        "old_stock": F.lag("stock_status").over(order),
        "previous_s": F.lag("s").over(order),
        "next_s": F.lead("s").over(order),
        "effective_category": F.coalesce(
            F.last(blank_to_null(F.col("category")), ignorenulls=True).over(so_far), F.first("category").over(so_far)
        ),
    })
    return rows.withColumns({
        "old_category": F.lag("effective_category").over(order),
        # A null predecessor is a null price unless this is the first row.
        "price_changed": ~F.col("is_first") & ~F.col("price").eqNullSafe(F.col("old_price")),
        "stock_changed": ~F.col("is_first") & (F.col("stock_status") != F.col("old_stock")),
        "reactivated": F.coalesce(F.col("s") - F.col("previous_s") > MISSES_UNTIL_REMOVED, F.lit(False)),
        # Scan in which the third miss in a row is counted, if there is one.
        "removed_s": F.when(
            F.coalesce("next_s", F.col("last_s") + 1) > F.col("s") + MISSES_UNTIL_REMOVED,
            F.col("s") + MISSES_UNTIL_REMOVED,
        ),
    })


def new_products(sequence: DataFrame) -> DataFrame:
    return sequence.where("is_first").select(*KEY, "scan_no", "price", "stock_status", F.col("effective_category").alias("category"))


def price_changes(sequence: DataFrame) -> DataFrame:
    diff = (F.col("price") - F.col("old_price")).cast("decimal(12,2)")
    return sequence.where("price_changed").select(
        *KEY, "scan_no", price_event_type(F.col("old_price"), F.col("price")).alias("event_type"), "old_price", "price",
        diff.alias("diff_amount"), percent(diff, F.col("old_price")).alias("diff_percentage"),
    )


def stock_changes(sequence: DataFrame) -> DataFrame:
    return sequence.where("stock_changed").select(
        *KEY, "scan_no", stock_event_type(F.col("stock_status")).alias("event_type"), "old_stock", "stock_status"
    )


def category_carry(sequence: DataFrame) -> DataFrame:
    return sequence.select(*KEY, "scan_no", F.col("effective_category").alias("category"))


def snapshot_rows(sequence: DataFrame) -> DataFrame:
    changed = "is_first or price_changed or stock_changed or not (effective_category <=> old_category)"
    return sequence.where(changed).select(*KEY, "scan_no", "price", "stock_status", F.col("effective_category").alias("category"))


def removed_products(sequence: DataFrame, calendar: DataFrame) -> DataFrame:
    """Removals with the scan that noticed them."""
    scans = calendar.select("competitor_id", F.col("s").alias("removed_s"), F.col("scan_no").alias("removed_scan"))
    return (
        sequence.where("removed_s is not null")
        .join(scans, ["competitor_id", "removed_s"])
        .select(*KEY, F.col("removed_scan").alias("scan_no"), F.col("scan_no").alias("last_seen_scan"))
    )


def reactivated_products(sequence: DataFrame) -> DataFrame:
    """Seen again after a removal; no event is written for it."""
    return sequence.where("reactivated").select(*KEY, "scan_no")


def missing_products(sequence: DataFrame) -> DataFrame:
    """Miss counter and active flag of every product after the last scan; the counter stops at the removal."""
    misses = F.least(F.col("last_s") - F.col("s"), F.lit(MISSES_UNTIL_REMOVED))
    return sequence.where("next_s is null").select(
        *KEY, misses.cast("int").alias("consecutive_misses"), (misses < MISSES_UNTIL_REMOVED).alias("active")
    )


def replay_history(observations: DataFrame) -> DataFrame:
    """All events of the history: (competitor_id, product_key, scan_no, event_type).

    The four kinds come from one pass over the sequence; only removals look up the scan calendar again.
    """
    sequence = replay_sequence(observations)
    kinds = F.array_compact(F.array(
        F.when(F.col("is_first"), F.struct(F.lit("new_product").alias("event_type"), F.col("s").alias("at"))),
        F.when(F.col("price_changed"),
               F.struct(price_event_type(F.col("old_price"), F.col("price")).alias("event_type"), F.col("s").alias("at"))),
        F.when(F.col("stock_changed"),
               F.struct(stock_event_type(F.col("stock_status")).alias("event_type"), F.col("s").alias("at"))),
        F.when(F.col("removed_s").isNotNull(),
               F.struct(F.lit("product_removed").alias("event_type"), F.col("removed_s").alias("at"))),
    ))
    scans = scan_calendar(observations).select("competitor_id", F.col("s").alias("at"), "scan_no")
    return (
        sequence.select(*KEY, F.explode(kinds).alias("k")).select(*KEY, "k.*")
        .join(scans, ["competitor_id", "at"]).select(*KEY, "scan_no", "event_type")
    )
