"""Live sales against their batch form, and pages by seek against pages by offset."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import listing
from shelfwatch.operators.dashboard import competitor_signals, daily_rollup, rolled_signals, sales_by_competitor
from shelfwatch.streaming import scans as streams

START = datetime(2024, 1, 1)


def test_live_sales_equal_the_batch(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, draw.randrange(3), draw.choice([None, 1, 2, 3, 4]), draw.choice(["stock_out", "stock_out", "stock_in"]), START + timedelta(minutes=7 * i))
            for i in range(900)]
    events = spark.createDataFrame(rows, "id long, competitor_id long, product_id long, event_type string, detected_at timestamp")
    source = str(tmp_path / "in")
    for low in range(0, 900, 300):
        events.where(F.col("id").between(low, low + 299)).coalesce(1).write.mode("append").parquet(f"{source}/{low}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    query = streams.windowed_sales(stream).writeStream.format("memory").queryName("sales").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    live, batch = (sorted(tuple(r) for r in f.collect()) for f in (spark.table("sales"), streams.windowed_sales(events)))
    days = sorted({r[0] for r in batch})
    assert len(days) == 5 and live == [r for r in batch if r[0] <= days[len({r[0] for r in live}) - 1]] and len({r[0] for r in live}) >= 3
    # the last day, as the dashboard tells it
    shops = spark.createDataFrame([(i, f"shop {i}") for i in range(3)], "id long, name string")
    today = sales_by_competitor(events, shops, days[-1] + timedelta(days=1)).collect()
    assert sorted((r.competitor_id, r.inferred_sold_count, r.unique_products_count, r.last_signal_at) for r in today) == [r[1:] for r in batch if r[0] == days[-1]]


@pytest.mark.parametrize("sort", sorted(listing.PRODUCT_SORTS))
def test_pages_by_seek_equal_pages_by_offset(spark, sort):
    draw = random.Random(2)
    at = lambda: draw.choice([None, START, START + timedelta(days=draw.randrange(4))])
    rows = [(i, draw.choice([None, "a", "b", "c"]), draw.choice([None, Decimal(1), Decimal(2), Decimal(3)]), at(), at()) for i in range(40)]
    products = spark.createDataFrame(rows, "id long, title string, current_price decimal(12,2), first_seen_at timestamp, last_checked_at timestamp")
    whole = [r.asDict() for r in products.orderBy(*listing.sort_columns(sort)).collect()]
    for i in (0, 7, 19, 33, 39):
        page = listing.product_page_after(products, whole[i], sort, page_size=6)
        assert [r.id for r in page.collect()] == [r["id"] for r in whole[i + 1 : i + 7]]


@pytest.mark.parametrize("start", [START, START + timedelta(days=2), START + timedelta(days=1, hours=5, minutes=3), START + timedelta(days=9)])
def test_rollups_equal_the_events_of_any_period(spark, start):
    draw = random.Random(3)
    rows = [(draw.randrange(4), draw.choice([None, 1, 2, 32768, 32769, 10**12]), draw.choice(["stock_out", "product_removed", "stock_in"]),
             START + timedelta(minutes=draw.randrange(5 * 1440))) for _ in range(600)]
    events = spark.createDataFrame(rows, "competitor_id long, product_id long, event_type string, detected_at timestamp")
    want, found = (sorted(f.select("competitor_id", "inferred_sold_count", "removed_count", "unique_products_count", "last_signal_at").collect())
                   for f in (competitor_signals(events, start), rolled_signals(daily_rollup(events), events, start)))
    assert found == want and (len(want) == 4 or start > START + timedelta(days=5))
