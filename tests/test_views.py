"""What a scan writes feeds every reader: lists, search, comparison, dashboard, notifications."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import compare, dashboard, listing, notify, search
from shelfwatch.schemas import ITEM_SCHEMA
from shelfwatch.sinks import state, views

TIMES = ("2024-03-01 08:00:00", "2024-03-01 09:00:00", "2024-03-01 10:00:00")


def landed(spark, *rows):
    full = [(c, i, f"https://s{c}.test/{u}", None, t, None if p is None else Decimal(p), "USD", s, None, None, "Lamps") for i, (c, u, t, p, s) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM_SCHEMA)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    scans = spark.createDataFrame([(1, False), (2, False)], "competitor_id long, allow_empty boolean")
    state.write_scan(spark, folder, 0, landed(spark, (1, "a", "Amber Lamp", "10", "in_stock"), (1, "b", "Birch Shelf", "4", "in_stock"), (2, "a", "Amber Lamp", "12", "in_stock")), scans, TIMES[0])
    state.write_scan(spark, folder, 1, landed(spark, (1, "a", "Amber Lamp", "8", "in_stock"), (1, "b", "Birch Shelf", "4", "out_of_stock")), scans, TIMES[1])
    errors = spark.createDataFrame([(2, "timed out")], "competitor_id long, error string")
    state.write_scan(spark, folder, 2, landed(spark, (1, "a", "Amber Lamp", "8", "in_stock"), (1, "b", "Birch Shelf", "4", "out_of_stock")), scans, TIMES[2], errors)
    shops = spark.createDataFrame([(i, f"shop {i}", "https://hook.test/1" if i == 1 else None, True, 60) for i in (1, 2, 3)],
                                  "id long, name string, webhook_url string, active boolean, scan_frequency_minutes int")
    return views.read_products(spark, folder), views.read_events(spark, folder), views.read_runs(spark, folder), shops


def test_lists(written):
    products, events, _, shops = written
    assert sorted(r.title for r in listing.product_list(products, shops, max_price=8).collect()) == ["Amber Lamp", "Birch Shelf"]
    kinds = sorted(r.event_type for r in listing.event_list(events, shops, products).collect())
    assert kinds == ["new_product"] * 3 + ["price_decrease"] + ["scrape_failed"] * 2 + ["stock_out"]
    assert events.select("id").distinct().count() == events.count()
    assert listing.activity_by_day(events).first().n_events == 7
    lamp = listing.event_list(events, shops, products, event_type="price_decrease").first()
    assert (lamp.product_title, lamp.competitor_name) == ("Amber Lamp", "shop 1")


def test_search_and_comparison(written):
    products, _, _, shops = written
    found = search.search_products(products, shops, "amber lamp").orderBy("pos").collect()
    assert [(r.current_price, r.competitor_name) for r in found][:2] == [(Decimal("8.00"), "shop 1"), (Decimal("12.00"), "shop 2")]
    rival = {r.competitor_id: r.current_price for r in compare.compare_product(products, shops, compare.compare_target(products, q="amber lamp")).collect()}
    assert rival == {1: Decimal("8.00"), 2: Decimal("12.00"), 3: None}
    assert compare.market_comparison(listing.product_list(products, shops)).count() > 0


def test_dashboard(written):
    products, events, runs, shops = written
    now = "2024-03-01 12:00:00"
    assert dashboard.failed_scans(runs, now).first()[0] == 2  # empty, then timed out
    top = dashboard.top_stockout_products(events, products, shops, now).collect()
    assert [(r.title, r.inferred_sold_count) for r in top] == [("Birch Shelf", 1)]
    status = {r.id: r.last_scan_status for r in views.with_scan_status(shops, runs).collect()}
    assert status == {1: "success", 2: "failed", 3: None}
    known = views.with_scan_status(shops, runs)
    assert [r.id for r in dashboard.attention_competitors(known).collect()] == [2]
    assert [r.id for r in notify.due_competitors(known, runs, "2024-03-01 10:30:00").collect()] == [3]


def test_notifications(spark, written):
    products, events, runs, shops = written
    none = spark.createDataFrame([], "competitor_id long")
    pending = notify.pending_events(events)
    outbox = notify.notification_outbox(pending, none, shops, products, TIMES[2], "https://hook.test/all").orderBy("webhook_url", "send_after").collect()
    assert {(r.event_type, r.send_after) for r in outbox if r.webhook_url.endswith("/all")} == {("new_product", 0)}
    own = [(r.event_type, r.send_after) for r in outbox if r.webhook_url.endswith("/1")]
    assert sorted(k for k, _ in own) == ["new_product", "new_product", "price_decrease", "stock_out"] and [n for _, n in own] == [0, 1, 2, 3]
    assert own[:2] == [("new_product", 0), ("new_product", 1)]  # oldest first
    sent = notify.new_deliveries(pending, none, spark.createDataFrame([(outbox[0].event_id,)], "event_id string"), TIMES[2])
    assert notify.pending_events(events, sent).count() == events.count() - 1
    summary = notify.summary_fanout(dashboard.daily_summary(events, runs, TIMES[2]), shops, "https://hook.test/all")
    message = notify.summary_messages(summary).first()
    assert {f["name"]: f["value"] for f in message.fields} == {
        "New Products": "3", "Price Changes": "1", "Failed Scans": "2", "Competitors Scanned": "2", "Biggest Price Drops": "None"}


def test_large_backlogs_are_announced(spark):
    pending = spark.createDataFrame([(i, 1, "new_product") for i in range(40)], "id long, competitor_id long, event_type string")
    none = spark.createDataFrame([], "competitor_id long")
    assert notify.suppressed_events(pending, none).count() == 0 and notify.deliverable_events(pending, none).count() == 40
    assert notify.suppressed_events(pending, none, backlog_limit=25).count() == 40


def test_messages_leave_in_event_order(spark):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.lit(0) - F.col("id")).alias("n"), F.lit("hook").alias("webhook_url"))
    rows = rows.withColumn("detected_at", F.timestamp_seconds(F.floor(F.col("n") / 7)))
    paced = notify.paced(rows, ranges=8).orderBy("detected_at", "event_id").collect()
    assert [r.send_after for r in paced] == list(range(3000))
