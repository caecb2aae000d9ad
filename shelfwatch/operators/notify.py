"""Which competitors to scan, which events to announce, and the announcement rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.constants import PRICE_EVENT_TYPES, PRICE_SIGNS
from shelfwatch.functions.prices import money
from shelfwatch.functions.text import blank_to_null, first_filled
from shelfwatch.operators.dashboard import as_datetime
from shelfwatch.operators.listing import product_key
from shelfwatch.session import at, cut_lineage, tasks_for

STOCK_EVENT_TYPES = ("stock_in", "stock_out")
#: Messages that one task sorts.
ROWS_PER_RANGE = 100_000
# Lengths of product texts, urls, errors and drop titles in rendered messages; the stored values stay whole.
SHOWN_TITLE, SHOWN_URL, SHOWN_ERROR, SHOWN_DROP = 100, 500, 500, 50


def due_competitors(competitors: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Active competitors never scanned or scanned longer ago than their frequency, without a run still going.

    A frequency of null or zero means an hour. A running run blocks for half an hour after its start.
    """
    minutes = F.coalesce(F.nullif("scan_frequency_minutes", F.lit(0)), F.lit(60))
    limit = at(competitors, "last_scan_at", now) - F.make_dt_interval(mins=minutes)
    stale = F.col("last_scan_at").isNull() | (F.col("last_scan_at") < limit)
    blocked = runs.where("status = 'running'").where(
        F.col("started_at") > at(runs, "started_at", as_datetime(now) - timedelta(minutes=30))
    )
    return competitors.where("active").where(stale).join(
        blocked.select(F.col("competitor_id").alias("id")), "id", "left_anti"
    )


def pending_events(events: DataFrame, deliveries: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """Events not sent yet: the sent state is the append-only `deliveries` (event_id), not a flag that is rewritten."""
    rows = events
    if deliveries is not None:
        rows = rows.join(deliveries.select(F.col("event_id").alias("id")), "id", "left_anti")
    if "notification_sent" in rows.columns:
        rows = rows.where("not notification_sent")
    return rows if scanned is None else rows.join(scanned.select("competitor_id"), "competitor_id", "left_semi")


def suppressing_competitors(pending: DataFrame, initial: DataFrame, backlog_limit: int | None = None) -> DataFrame:
    """Competitors whose new products are not announced: first scans, and backlogs above `backlog_limit` where it is given.

    The backlog is counted with partial aggregation and only the resulting ids are joined, so a competitor with most of
    the pending events is not gathered in one task.
    """
    if backlog_limit is None:
        return initial.select("competitor_id").distinct()
    backlog = pending.where("event_type = 'new_product'").groupBy("competitor_id").agg(F.count("*").alias("n"))
    large = backlog.where(F.col("n") > backlog_limit).select("competitor_id")
    return large.unionByName(initial.select("competitor_id")).distinct()


def suppressed_events(pending: DataFrame, initial: DataFrame, backlog_limit: int | None = None) -> DataFrame:
    """New-product events to be marked as sent without a message."""
    quiet = suppressing_competitors(pending, initial, backlog_limit)
    return pending.where("event_type = 'new_product'").join(quiet, "competitor_id", "left_semi")


def deliverable_events(pending: DataFrame, initial: DataFrame, backlog_limit: int | None = None) -> DataFrame:
    """Pending events without the suppressed ones."""
    quiet = suppressing_competitors(pending, initial, backlog_limit).withColumn("quiet", F.lit(True))
    marked = pending.join(quiet, "competitor_id", "left")
    return marked.where("event_type <> 'new_product' or quiet is null").drop("quiet")


def routed_events(events: DataFrame, competitors: DataFrame, products: DataFrame, default_webhook: str | None = None) -> DataFrame:
    """Deliverable events with webhook, competitor and product.

    The competitor's webhook beats the default one; without either, or where a type needs its product and the product
    is gone, nothing is sent. Failed scans are announced elsewhere.
    """
    c = F.col
    shops = competitors.select(
        c("id").alias("competitor_id"), c("name").alias("competitor_name"),
        F.coalesce(blank_to_null(c("webhook_url")), blank_to_null(F.lit(default_webhook))).alias("target"),
    )
    items = products.select(
        F.lit(True).alias("has_product"), c("id").alias("product_key"), c("title").alias("product_title"),
        c("url").alias("product_url"), c("category").alias("product_category"), c("currency").alias("product_currency"),
        c("stock_status").alias("product_stock"), F.lit(True).alias("found"),
    )
    needs = c("event_type").isin("new_product", *PRICE_EVENT_TYPES, *STOCK_EVENT_TYPES)
    wanted = events.where(needs | (c("event_type") == "product_removed")).select(
        "*", *product_key(F.when(needs, c("product_id")), c("id"))
    )
    joined = wanted.join(items, ["has_product", "product_key"], "left").where(~needs | c("found"))
    return joined.drop("has_product", "product_key", "found").join(shops, "competitor_id").where("target is not null")


def _field(name: str, value: Column, inline: bool = True) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))


def render_messages(routed: DataFrame, now, *keep: str) -> DataFrame:
    """One message per event: content line, title, color and fields (name, value, inline), and the columns of `routed` to keep."""
    c = F.col
    old, new = c("old_value"), c("new_value")
    unnamed = F.lit("Uncategorized")
    shop = c("competitor_name")
    category = F.coalesce(
        F.when(c("event_type") == "product_removed", blank_to_null(old["category"]))
        .when(c("event_type") == "new_product", first_filled(c("product_category"), new["category"]))
        .otherwise(first_filled(c("product_category"), new["category"], old["category"])),
        unnamed,
    )
    price_event = c("event_type").isin(*PRICE_EVENT_TYPES)
    rise = c("event_type") == "price_increase"
    stock_event = c("event_type").isin(*STOCK_EVENT_TYPES)
    is_new = c("event_type") == "new_product"
    rows = routed.withColumn("shown_category", category)

    diff = new["price"] - old["price"]
    pct = F.when(old["price"] != 0, diff.cast("double") / old["price"].cast("double") * 100).otherwise(F.lit(0.0))
    amount = lambda v: money(v, c("product_currency"), PRICE_SIGNS)
    change = F.when(diff.isNull(), "N/A").otherwise(F.concat(amount(diff), F.format_string(" (%+.1f%%)", pct)))
    detected = _field("Detected", F.lit(as_datetime(now).strftime("%Y-%m-%d %H:%M UTC")))
    head = [_field("Competitor", shop), _field("Category", c("shown_category"))]
    product = _field("Product", F.substring("product_title", 1, SHOWN_TITLE), False)
    link = _field("URL", F.substring("product_url", 1, SHOWN_URL), False)
    gone_title, gone_url = (F.coalesce(old[k], F.lit("N/A")) for k in ("title", "url"))
    fields = (
        F.when(is_new, F.array(
            *head, product, _field("Price", amount(new["price"])), _field("Stock", F.coalesce("product_stock", F.lit("unknown"))),
            link, detected))
        .when(price_event, F.array(
            *head, product, _field("Old Price", amount(old["price"])), _field("New Price", amount(new["price"])),
            _field("Difference", change), link, detected))
        .when(stock_event, F.array(
            *head, product, _field("Old Stock", F.coalesce(old["stock_status"], F.lit("unknown"))),
            _field("New Stock", F.coalesce(new["stock_status"], F.lit("unknown"))), link))
        .otherwise(F.array(
            *head, _field("Product", F.substring(gone_title, 1, SHOWN_TITLE), False), _field("URL", F.substring(gone_url, 1, SHOWN_URL), False), detected))
    )
    # Only rises are worded as such; every other price event reads as a decrease.
    wording = (
        F.when(is_new, "New product").when(rise, "Price increased").when(price_event, "Price decreased")
        .when(stock_event, "Stock changed").otherwise("Product removed")
    )
    title = (
        F.when(is_new, "🆕 New Product Found").when(rise, "📈 Price Changed").when(price_event, "📉 Price Changed")
        .when(stock_event, "📦 Stock Status Changed").otherwise("❌ Product No Longer Seen")
    )
    color = F.when(is_new, 0x00AA00).when(rise, 0xFF4444).when(price_event, 0x00CC44).when(stock_event, 0xFFAA00).otherwise(0x666666)
    return rows.select(
        c("id").alias("event_id"), "detected_at", "competitor_id", "event_type", c("target").alias("webhook_url"),
        F.concat(F.lit("**"), shop, F.lit("**\n**Category:** "), "shown_category", F.lit("\n**Change:** "), wording).alias("content"),
        title.alias("title"), color.alias("color"), fields.alias("fields"), *keep,
    )


def failure_messages(failures: DataFrame, competitors: DataFrame, now, default_webhook: str | None = None) -> DataFrame:
    """Messages of failed scans (competitor_id, error)."""
    target = F.coalesce(blank_to_null(F.col("webhook_url")), blank_to_null(F.lit(default_webhook)))
    shops = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"), target.alias("webhook_url"))
    stamp = F.lit(as_datetime(now).strftime("%Y-%m-%d %H:%M UTC"))
    return failures.join(shops, "competitor_id").where("webhook_url is not null").select(
        "competitor_id", "webhook_url", F.lit("❌ Competitor Scan Failed").alias("title"), F.lit(0xFF0000).alias("color"),
        F.array(_field("Competitor", F.col("competitor_name")), _field("Error", F.substring("error", 1, SHOWN_ERROR), False),
                _field("Time", stamp)).alias("fields"),
    )


def paced(messages: DataFrame, ranges: int | None = None, clock: DataFrame | None = None, now=None) -> DataFrame:
    """Messages with `send_after`: their second, counted from now, in the queue of their webhook, oldest event first, one message per second.

    `clock` (webhook_url, free_at) tells when the queues of earlier batches end; a queue that ends after `now` is joined at its end.

    One default webhook may receive nearly everything, so no window runs over a whole webhook: messages are dealt to ranges
    of (detected_at, event_id) between sampled splitters, numbered inside their range, and shifted by the sizes of the
    ranges before, which are one small row each. The sorted messages are written once, because their numbering and the
    sizes must see the same ranges.
    """
    order = ["detected_at", "event_id"]
    # Splitters are drawn from all rows, so these are computed once before; a range is as many rows as a task sorts.
    messages = cut_lineage(messages)
    parts = ranges or tasks_for(messages, ROWS_PER_RANGE)
    rows = cut_lineage(messages.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    sizes = rows.groupBy("webhook_url", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("webhook_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("webhook_url", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if clock is not None:
        ahead = F.unix_seconds("free_at") - F.unix_seconds(F.lit(str(now)).cast("timestamp"))
        queued = clock.select("webhook_url", F.greatest(ahead, F.lit(0)).alias("queued"))
        starts = starts.join(queued, "webhook_url", "left").withColumn("start", F.col("start") + F.coalesce("queued", F.lit(0))).drop("queued")
    inside = Window.partitionBy("webhook_url", "range").orderBy(*order)
    numbered = rows.withColumn("rn", F.row_number().over(inside))
    return numbered.join(starts, ["webhook_url", "range"]).withColumn("send_after", F.col("start") + F.col("rn") - 1).drop("range", "rn", "start")


def queue_clock(outbox: DataFrame, now, clock: DataFrame | None = None) -> DataFrame:
    """(webhook_url, free_at): when the queue of every webhook ends after this outbox; one row per webhook."""
    end = F.timestamp_seconds(F.unix_seconds(F.lit(str(now)).cast("timestamp")) + F.max("send_after") + 1)
    ends = outbox.groupBy("webhook_url").agg(end.alias("free_at"))
    if clock is not None:
        ends = ends.unionByName(clock).groupBy("webhook_url").agg(F.max("free_at").alias("free_at"))
    return ends


def notification_outbox(
    pending: DataFrame, initial: DataFrame, competitors: DataFrame, products: DataFrame, now,
    default_webhook: str | None = None, enabled: bool = True, backlog_limit: int | None = None, clock: DataFrame | None = None,
) -> DataFrame:
    """Paced and rendered messages of all deliverable events. Switched off, it is empty and no event counts as sent.

    Events are sorted and numbered before they are rendered, because a message is several times as large.
    """
    events = deliverable_events(pending, initial, backlog_limit)
    if not enabled:
        events = events.limit(0)
    routed = routed_events(events, competitors, products, default_webhook)
    keyed = routed.select("*", F.col("id").alias("event_id"), F.col("target").alias("webhook_url")).drop("event_message")
    return render_messages(paced(keyed, clock=clock, now=now), now, "send_after")


def new_deliveries(pending: DataFrame, initial: DataFrame, outbox: DataFrame, now, backlog_limit: int | None = None) -> DataFrame:
    """Rows to append to `deliveries`: suppressed events and handed-over messages."""
    sent_at = F.lit(str(now)).cast("timestamp").alias("sent_at")
    quiet = suppressed_events(pending, initial, backlog_limit).select(F.col("id").alias("event_id"), F.lit("suppressed").alias("reason"), sent_at)
    return quiet.unionByName(outbox.select("event_id", F.lit("outbox").alias("reason"), sent_at))


def summary_fanout(summary: DataFrame, competitors: DataFrame, default_webhook: str | None = None, drops: DataFrame | None = None, shown_drops: int = 5) -> DataFrame:
    """The one-row daily summary for the default webhook and every distinct one of an active competitor.

    The first `shown_drops` of `drops` (title, old_price, new_price, pos) are shown as text.
    """
    hooks = competitors.where("active").select(blank_to_null(F.col("webhook_url")).alias("webhook_url")).where("webhook_url is not null")
    if default_webhook:
        extra = competitors.sparkSession.range(1).select(F.lit(default_webhook).alias("webhook_url"))
        hooks = hooks.unionByName(extra)
    one = F.lit(1).alias("one")
    text = F.lit("None")
    rows = summary.select("*", one)
    if drops is not None:
        line = F.concat(F.lit("• "), F.substring("title", 1, SHOWN_DROP), F.lit(": "), money(F.col("old_price"), F.lit("USD"), PRICE_SIGNS),
                        F.lit(" → "), money(F.col("new_price"), F.lit("USD"), PRICE_SIGNS))
        shown = drops.where(F.col("pos") <= shown_drops).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("d"))
        rows = rows.join(shown.select(F.array_join(F.transform("d", lambda x: x["l"]), "\n").alias("drops_text"), one), "one")
        text = F.coalesce(blank_to_null(F.col("drops_text")), F.lit("None"))
    rows = rows.withColumn("biggest_drops", text)
    if drops is not None:
        rows = rows.drop("drops_text")
    return hooks.distinct().select("*", one).join(rows, "one").drop("one")


def summary_messages(fanout: DataFrame) -> DataFrame:
    """The rendered daily summary for every webhook of `summary_fanout`."""
    counts = {"New Products": "new_products_today", "Price Changes": "price_changes_today", "Failed Scans": "failed_scans", "Competitors Scanned": "competitors_scanned"}
    fields = [_field(name, F.col(column).cast("string")) for name, column in counts.items()]
    return fanout.select(
        "webhook_url", F.lit("📊 Daily Market Monitor Summary").alias("title"), F.lit(0x5865F2).alias("color"),
        F.array(*fields, _field("Biggest Price Drops", F.col("biggest_drops"), False)).alias("fields"),
    )
