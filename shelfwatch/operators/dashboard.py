"""Counters, sales signals and summaries over the event log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.constants import PRICE_EVENT_TYPES, SALES_PERIOD_DAYS
from shelfwatch.operators.listing import event_rows, first_page
from shelfwatch.session import at

SOLD = "stock_out"


def as_datetime(now) -> datetime:
    return now if isinstance(now, datetime) else datetime.fromisoformat(str(now))


def midnight(now) -> datetime:
    return as_datetime(now).replace(hour=0, minute=0, second=0, microsecond=0)


def period_start(now, period: str) -> datetime:
    """Trailing 1, 7 or 30 days; the start belongs to the period."""
    return as_datetime(now) - timedelta(days=SALES_PERIOD_DAYS[period])


def since(df: DataFrame, column: str, start) -> DataFrame:
    """Rows from `start` on. A log's `day` is the date of its time column, so days before are not even listed for reading."""
    rows = df.where(F.col("day") >= F.lit(as_datetime(start).date())) if "day" in df.columns else df
    return rows.where(F.col(column) >= at(df, column, start))


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def dashboard_counters(events: DataFrame, now) -> DataFrame:
    """One pass over today's events instead of one query per counter."""
    return since(events, "detected_at", midnight(now)).agg(
        F.count_if(_is("new_product")).alias("new_products_today"),
        F.count_if(_is(*PRICE_EVENT_TYPES)).alias("price_changes_today"),
        F.count_if(_is("price_decrease")).alias("price_drops_today"),
        F.count_if(_is("price_increase")).alias("price_increases_today"),
    )


def failed_scans(runs: DataFrame, now) -> DataFrame:
    today = since(runs, "started_at", midnight(now))
    return today.where("status = 'failed'").agg(F.count("*").alias("failed_scans_today"))


def latest_events(events: DataFrame, competitors: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    """The newest `n` events with competitor and product, in order.

    Events of a deleted competitor do not count, so they are removed before the top-n; the product is looked up for
    the `n` survivors only.
    """
    known = events.join(competitors.select(F.col("id").alias("competitor_id")), "competitor_id", "left_semi")
    newest = first_page(known, [F.col("detected_at").desc_nulls_first(), F.col("id").desc()], 1, n)
    return event_rows(newest, competitors, products, "pos")


def attention_competitors(competitors: DataFrame) -> DataFrame:
    """Active competitors whose last scan failed."""
    return competitors.where("active and last_scan_status = 'failed'")


def competitor_signals(events: DataFrame, start, competitor_id: int | None = None) -> DataFrame:
    """Sale and removal signals per competitor id in one pass.

    Distinct products and the last signal come from sale rows only. The distinct count is planned as a second
    aggregation level, so one competitor holding most events is spread over its products before it is combined.
    """
    rows = since(events, "detected_at", start).where(_is("stock_out", "product_removed"))
    if competitor_id is not None:
        rows = rows.where(F.col("competitor_id") == competitor_id)
    sold = F.col("event_type") == SOLD
    return rows.groupBy("competitor_id").agg(
        F.count_if(sold).alias("inferred_sold_count"),
        F.count_if(~sold).alias("removed_count"),
        F.count_distinct(F.when(sold, F.col("product_id"))).alias("unique_products_count"),
        F.max(F.when(sold, F.col("detected_at"))).alias("last_signal_at"),
    )


def sales_by_competitor(events: DataFrame, competitors: DataFrame, now, period: str = "day") -> DataFrame:
    """Competitors with at least one sale signal in the period, active or not."""
    signals = competitor_signals(events, period_start(now, period)).where("inferred_sold_count > 0").drop("removed_count")
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return signals.join(names, "competitor_id").select(
        "competitor_id", "competitor_name", "inferred_sold_count", "unique_products_count", "last_signal_at"
    )


def sales_trends(
    events: DataFrame, competitors: DataFrame, now, period: str = "day", competitor_id: int | None = None
) -> DataFrame:
    """Every active competitor with its signals, zero where it was silent; most sales first, then by name."""
    return trends_of(competitor_signals(events, period_start(now, period), competitor_id), competitors, competitor_id)


def trends_of(signals: DataFrame, competitors: DataFrame, competitor_id: int | None = None) -> DataFrame:
    """`sales_trends` from the signals of a period, however they were counted."""
    active = competitors.where("active").select(
        F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name")
    )
    if competitor_id is not None:
        active = active.where(F.col("competitor_id") == competitor_id)
    counts = ("inferred_sold_count", "removed_count", "unique_products_count")
    return (
        active.join(signals, "competitor_id", "left")
        .select(
            "competitor_id", "competitor_name",
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
            "last_signal_at",
        )
        .orderBy(F.desc("inferred_sold_count"), "competitor_name", "competitor_id")
    )


def daily_rollup(events: DataFrame) -> DataFrame:
    """(day, competitor_id, bucket, sold, removed, last_signal_at, products): what the sales views of any period need of the events of a day.

    `products` is an exact bitmap of the numbers of the products sold, of one bucket of 32,768 numbers; signals without a product have a row without
    bucket. Rollups of finished days are written once and merged for any period, so periods read no events again.
    """
    sold = F.col("event_type") == SOLD
    number = F.when(sold, F.col("product_id").cast("long"))
    rows = events.where(_is(SOLD, "product_removed")).select(
        F.to_date("detected_at").alias("day"), "competitor_id", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"),
        sold.alias("is_sale"), "detected_at",
    )
    return rows.groupBy("day", "competitor_id", "bucket").agg(
        F.count_if("is_sale").alias("sold"), F.count_if(~F.col("is_sale")).alias("removed"),
        F.max(F.when(F.col("is_sale"), F.col("detected_at"))).alias("last_signal_at"), F.bitmap_construct_agg("bit").alias("products"),
    )


def rolled_signals(rollups: DataFrame, events: DataFrame, start) -> DataFrame:
    """`competitor_signals` from rollups of whole days; `events` are asked only for the rest of a first day that the period cuts."""
    start = as_datetime(start)
    first = start.date() if start == midnight(start) else (start + timedelta(days=1)).date()
    rows = rollups.where(F.col("day") >= F.lit(first))
    if start != midnight(start):
        rest = since(events, "detected_at", start).where(F.col("detected_at") < at(events, "detected_at", datetime(first.year, first.month, first.day)))
        rows = rows.unionByName(daily_rollup(rest))
    merged = rows.groupBy("competitor_id", "bucket").agg(
        F.sum("sold").alias("sold"), F.sum("removed").alias("removed"), F.max("last_signal_at").alias("last_signal_at"), F.bitmap_or_agg("products").alias("products"))
    return merged.groupBy("competitor_id").agg(
        F.sum("sold").alias("inferred_sold_count"), F.sum("removed").alias("removed_count"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("products")).otherwise(0)).alias("unique_products_count"), F.max("last_signal_at").alias("last_signal_at"),
    )


def top_stockout_products(
    events: DataFrame, products: DataFrame, competitors: DataFrame, now, period: str = "day",
    competitor_id: int | None = None, limit: int = 25,
) -> DataFrame:
    """Products with the most sale signals.

    Counted by product id before anything is joined: the join then handles one row per product, not one per event.
    """
    rows = since(events, "detected_at", period_start(now, period)).where(F.col("event_type") == SOLD)
    if competitor_id is not None:
        rows = rows.where(F.col("competitor_id") == competitor_id)
    counted = rows.where("product_id is not null").groupBy("product_id").agg(
        F.count("*").alias("inferred_sold_count"), F.max("detected_at").alias("last_signal_at")
    )
    attributes = ("title", "category", "url", "image_url", "current_price", "currency", "stock_status", "competitor_id")
    named = counted.join(products.select(F.col("id").alias("product_id"), *attributes), "product_id").join(
        competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name")), "competitor_id"
    )
    order = [F.desc("inferred_sold_count"), F.desc("last_signal_at"), F.asc("title"), F.asc("product_id")]
    if limit < 1:
        raise ValueError("limit must be positive")
    return first_page(named, order, 1, limit)


def sales_totals(trends: DataFrame) -> DataFrame:
    """Sums over the displayed competitors, the number with signals and the busiest one."""
    sold = F.col("inferred_sold_count")
    best = F.min_by("competitor_name", F.struct((-sold).alias("a"), F.col("competitor_name")))
    return trends.agg(
        F.coalesce(F.sum(sold), F.lit(0)).cast("long").alias("total_inferred_sold"),
        F.coalesce(F.sum("removed_count"), F.lit(0)).cast("long").alias("total_removed"),
        F.count_if(sold > 0).alias("sites_with_signals"),
        F.when(F.max(sold) > 0, best).alias("top_site"),
    )


def daily_summary(events: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Counts of the day for the summary message; here only rises and drops are price changes."""
    start = midnight(now)
    changes = since(events, "detected_at", start).agg(
        F.count_if(_is("new_product")).alias("new_products_today"),
        F.count_if(_is("price_increase", "price_decrease")).alias("price_changes_today"),
    )
    scans = since(runs, "started_at", start).agg(
        F.count_if(F.col("status") == "failed").alias("failed_scans"),
        F.count_distinct("competitor_id").alias("competitors_scanned"),
    )
    # Both sides are global aggregates of exactly one row; the constant key makes it a plain equi-join.
    one = F.lit(1).alias("one")
    return changes.select("*", one).join(scans.select("*", one), "one").drop("one")


def biggest_drops(price_events: DataFrame, now, limit: int = 5) -> DataFrame:
    """Today's largest price decreases by amount, in order."""
    rows = since(price_events, "detected_at", midnight(now)).where("event_type = 'price_decrease'")
    rows = rows.withColumn("diff_amount", F.col("new_price") - F.col("old_price"))
    return first_page(rows, [F.asc_nulls_last("diff_amount"), F.asc("id")], 1, limit)


def events_by_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Event counts per tumbling window and type, the batch twin of the streaming count."""
    stamped = events.withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    return (
        stamped.groupBy(F.window("detected_at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )
