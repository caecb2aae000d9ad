"""Exports, versioned state, notifications and streaming."""

import glob
import json
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwatch.functions.constants import EXPORT_FIELDS
from shelfwatch.operators import history, notify
from shelfwatch.operators.dashboard import events_by_window
from shelfwatch.plans.fixtures import view
from shelfwatch.schemas import ITEM_SCHEMA, SCAN_SCHEMA
from shelfwatch.sinks import export, state
from shelfwatch.streaming import scans as streams

FOLDER = "/root/testdata/sf0.001"
NOW = "2024-01-31 10:00:00"


def text_of(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def items(spark, rows):
    full = [(c, ix, u, None, t, Decimal(p), "USD", s, None, None, "cat") for c, ix, u, t, p, s in rows]
    return spark.createDataFrame(full, ITEM_SCHEMA)


def export_frame(spark):
    rows = items(spark, [(1, i, f"https://e.com/p{i}", t, p, "in_stock") for i, (t, p) in enumerate([("b", "2"), ("A", "1"), ("a", "3"), ('qu"ote', "4")])])
    rows = rows.withColumn("collection_url", F.lit("https://e.com/collections/é"))
    shops = spark.createDataFrame([(1, "Shop", "https://e.com/")], "id long, name string, base_url string")
    return export.export_rows(rows, shops, "2024-01-31T00:00:00+00:00")


def test_export_formats(spark, tmp_path):
    rows = export_frame(spark)
    export.write_csv(rows, str(tmp_path / "csv"))
    assert text_of(tmp_path / "csv").splitlines()[0] == ",".join(EXPORT_FIELDS)
    export.write_jsonl(rows, str(tmp_path / "jsonl"))
    lines = [json.loads(line) for line in text_of(tmp_path / "jsonl").splitlines()]
    assert [r["title"] for r in lines] == ["A", "a", "b", 'qu"ote'] and all(list(r) == list(EXPORT_FIELDS) for r in lines)
    assert lines[0]["sku"] is None
    export.write_documents(rows, str(tmp_path / "docs"))
    (folder,) = glob.glob(f"{tmp_path}/docs/document=*")
    doc = json.loads(text_of(folder))
    assert (doc["competitor"], doc["collection_url"], doc["products_count"]) == ("Shop", "https://e.com/collections/é", 4)
    assert [r["title"] for r in doc["items"]] == ["A", "a", "b", 'qu"ote']


def test_versioned_state(spark, tmp_path):
    folder = str(tmp_path / "store")
    scans = spark.createDataFrame([(1, False)], SCAN_SCHEMA)
    first = items(spark, [(1, 0, "u1", "One", "1", "in_stock"), (1, 1, "u2", "Two", "2", "in_stock")])
    second = items(spark, [(1, 0, "u1", "One", "5", "in_stock")])
    state.write_scan(spark, folder, 0, first, scans, "2024-01-01 00:00:00")
    state.write_scan(spark, folder, 1, second, scans, "2024-01-02 00:00:00")
    assert state.write_scan(spark, folder, 1, second, scans, "2024-01-02 00:00:00") is None
    for n in (2, 3):
        state.write_scan(spark, folder, n, second, scans, f"2024-01-0{n + 1} 00:00:00")
    events = Counter((r.batch, r.event_type) for r in state.read_log(spark, folder, "events").collect())
    assert events == {(0, "new_product"): 2, (1, "price_increase"): 1, (3, "product_removed"): 1}
    final = {r.url: (r.price, r.active, r.consecutive_misses) for r in state.read_state(spark, folder).collect()}
    assert final == {"u1": (Decimal("5.00"), True, 0), "u2": (Decimal("2.00"), False, 3)}
    runs = {r.batch: (r.status, r.products_found, r.new_products_count, r.price_changes_count) for r in state.read_log(spark, folder, "runs").collect()}
    assert runs[0] == ("success", 2, 2, 0) and runs[1] == ("success", 1, 0, 1)
    assert [r.day.isoformat() for r in state.read_log(spark, folder, "snapshots").where("batch = 1").collect()] == ["2024-01-02"]


def test_unfinished_batch_is_invisible_and_repeatable(spark, tmp_path):
    folder = str(tmp_path / "store")
    scans = spark.createDataFrame([(1, False)], SCAN_SCHEMA)
    state.write_scan(spark, folder, 0, items(spark, [(1, 0, "u1", "One", "1", "in_stock")]), scans, NOW)
    batch = items(spark, [(1, 0, "u1", "One", "2", "in_stock")])
    state.write_scan(spark, folder, 1, batch, scans, NOW)
    # As if the job had died before its state was committed.
    os.rename(f"{folder}/state/batch=1/_SUCCESS", f"{folder}/state/batch=1/_lost")
    assert state.current_version(spark, folder) == 0
    assert state.read_log(spark, folder, "events").where("batch = 1").count() == 0
    state.write_scan(spark, folder, 1, batch, scans, NOW)
    assert state.read_log(spark, folder, "events").where("batch = 1").count() == 1
    assert state.read_state(spark, folder).first().price == Decimal("2.00")


def test_scan_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    items(spark, [(1, 0, "u1", "One", "1", "in_stock")]).write.parquet(source)
    run = lambda: streams.scan_stream(spark.readStream.schema(ITEM_SCHEMA).parquet(source), folder, str(tmp_path / "cp"), lambda n: NOW).awaitTermination()
    run()
    items(spark, [(1, 0, "u1", "One", "2", "out_of_stock")]).write.mode("append").parquet(source)
    run()
    run()
    kinds = Counter(r.event_type for r in state.read_log(spark, folder, "events").collect())
    assert kinds == {"new_product": 1, "price_increase": 1, "stock_out": 1}


def test_a_scan_split_over_micro_batches_misses_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    schema = streams.OPEN_SCHEMA
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: streams.scan_stream(stream(), folder, str(tmp_path / "cp"), lambda n: NOW).awaitTermination()

    def land(scan, urls, end=None):
        rows = items(spark, [(1, ix, u, u, "1", "in_stock") for ix, u in urls]).selectExpr("*", f"{scan}L as scan_id", "cast(null as long) as scan_end")
        if end is not None:
            marker = spark.createDataFrame([(1, scan, end)], "competitor_id long, scan_id long, scan_end long")
            rows = rows.unionByName(marker, allowMissingColumns=True)
        rows.coalesce(1).write.mode("append").parquet(source)
        run()

    for scan in range(1, 5):
        land(scan, [(0, "u1")])
        land(scan, [(1, "u2")], end=3)  # the end comes before the last item
        land(scan, [(2, "u3")])
    run()
    assert Counter(r.event_type for r in state.read_log(spark, folder, "events").collect()) == {"new_product": 3}
    assert [(r.active, r.consecutive_misses) for r in state.read_state(spark, folder).collect()] == [(True, 0)] * 3
    assert state.current_version(spark, folder) == 3
    for scan in range(5, 8):
        land(scan, [(0, "u1")])
        land(scan, [(1, "u2")], end=2)
    assert {r.url: (r.active, r.consecutive_misses) for r in state.read_state(spark, folder).collect()} == {"u1": (True, 0), "u2": (True, 0), "u3": (False, 3)}
    land(8, [(0, "u1")])  # never ended
    assert state.current_version(spark, folder) == 6


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    items(spark, [(1, 0, "u1", "One", "1", "in_stock")]).write.parquet(source)
    run = lambda cp: streams.scan_stream(spark.readStream.schema(ITEM_SCHEMA).parquet(source), folder, str(tmp_path / cp), lambda n: NOW).awaitTermination()
    run("first")
    items(spark, [(1, 0, "u1", "One", "9", "in_stock")]).write.mode("overwrite").parquet(source)
    run("second")
    assert state.read_state(spark, folder).first().price == Decimal("9.00")


def test_a_batch_that_died_stays_invisible(spark, tmp_path):
    folder, scans = str(tmp_path), spark.createDataFrame([(1, False)], "competitor_id long, allow_empty boolean")
    for batch, price in ((0, "1"), (1, "2")):
        state.write_scan(spark, folder, batch, items(spark, [(1, 0, "u1", "One", price, "in_stock")]), scans, NOW)
    os.rename(f"{folder}/state/batch=1/_SUCCESS", f"{folder}/state/batch=1/_lost")
    state.write_scan(spark, folder, 2, items(spark, [(1, 0, "u1", "One", "3", "in_stock")]), scans, NOW)
    changes = state.read_log(spark, folder, "events").where("event_type = 'price_increase'").collect()
    assert [(r.old_value["price"], r.new_value["price"]) for r in changes] == [(Decimal("1.00"), Decimal("3.00"))]


def test_errored_scans_count_no_miss_and_apply_nothing(spark, tmp_path):
    folder, scans = str(tmp_path), spark.createDataFrame([(1, True)], "competitor_id long, allow_empty boolean")
    state.write_scan(spark, folder, 0, items(spark, [(1, 0, "u1", "One", "1", "in_stock")]), scans, NOW)
    errors = spark.createDataFrame([(1, "timed out"), (2, "no answer")], "competitor_id long, error string")
    state.write_scan(spark, folder, 1, items(spark, [(1, 0, "u1", "One", "5", "in_stock")]), scans, NOW, errors)
    for batch in (2, 3, 4):
        state.write_scan(spark, folder, batch, items(spark, []), scans, NOW, errors)
    row = state.read_state(spark, folder).first()
    assert (row.price, row.consecutive_misses, row.active) == (Decimal("1.00"), 0, True)
    runs = state.read_log(spark, folder, "runs").where("batch = 1").collect()
    assert sorted((r.competitor_id, r.status, r.error_message) for r in runs) == [(1, "failed", "timed out"), (2, "failed", "no answer")]


def test_item_stream_equals_replay(spark, tmp_path):
    observed = view(spark, FOLDER, "observations").withColumns({
        "competitor_id": F.col("competitor_id").cast("long"), "product_key": F.col("product_key").cast("string"), "scan_no": F.col("scan_no").cast("long")})
    source = str(tmp_path / "in")
    for low, high in ((0, 10), (10, 20), (20, 99)):
        observed.where((F.col("scan_no") > low) & (F.col("scan_no") <= high)).coalesce(1).write.mode("append").parquet(f"{source}/{low:02d}")
    stream = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    query = streams.item_changes(stream).writeStream.format("memory").queryName("changes").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = Counter((r.competitor_id, r.product_key, r.scan_no, r.event_type) for r in spark.table("changes").collect())
    replay = history.replay_history(observed).where("event_type <> 'product_removed'")
    assert got == Counter((r.competitor_id, r.product_key, r.scan_no, r.event_type) for r in replay.collect())


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = view(spark, FOLDER, "market_events").select("event_type", "detected_at")
    source = str(tmp_path / "in")
    events.coalesce(1).sortWithinPartitions("detected_at").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = streams.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.window_start, r.event_type, r.n)
    closed = {key(r) for r in spark.table("windows").collect()}
    everything = {key(r) for r in events_by_window(events).collect()}
    assert closed and closed <= everything
    assert {w for w, *_ in everything - closed} <= set(sorted({w for w, *_ in everything})[-4:])


def shops(spark, **hooks):
    rows = [(i, f"s{i}", hooks.get(f"h{i}"), True, 60, None) for i in range(1, 4)]
    return spark.createDataFrame(rows, "id long, name string, webhook_url string, active boolean, scan_frequency_minutes int, last_scan_at timestamp")


PAYLOAD = "struct<title:string,url:string,price:decimal(12,2),stock_status:string,category:string>"


def events(spark, rows):
    return spark.createDataFrame(rows, f"id long, competitor_id long, product_id long, event_type string, notification_sent boolean, old_value {PAYLOAD}, new_value {PAYLOAD}")


def products(spark):
    return spark.createDataFrame([(7, "Long " * 40, "https://e.com/7", None, "EUR", "in_stock")],
                                 "id long, title string, url string, category string, currency string, stock_status string")


def test_routing(spark):
    rows = events(spark, [(i, c, p, kind, False, None, None) for i, (c, p, kind) in enumerate([
        (1, 7, "stock_in"), (2, 7, "stock_in"), (1, None, "stock_in"), (1, 8, "price_increase"), (1, None, "product_removed"), (1, 7, "scrape_failed"), (9, 7, "stock_in")])])
    own = {r.id: r.target for r in notify.routed_events(rows, shops(spark, h1="https://c"), products(spark), "https://d").collect()}
    assert own == {0: "https://c", 1: "https://d", 4: "https://c"}
    alone = {r.id for r in notify.routed_events(rows, shops(spark, h1="https://c", h2=""), products(spark)).collect()}
    assert alone == {0, 4}


def test_rendering(spark):
    price = lambda p: (None, None, Decimal(p), None, "g")
    rows = events(spark, [(0, 1, 7, "price_decrease", False, price("20.00"), price("15.00")), (1, 1, 7, "price_changed", False, None, price("15.00")),
                          (2, 1, 7, "new_product", False, None, (None, None, None, None, None)), (3, 1, 7, "price_increase", False, price("0.00"), price("1.00"))])
    rows = rows.withColumn("detected_at", F.lit(NOW).cast("timestamp"))
    out = {r.event_id: r for r in notify.render_messages(notify.routed_events(rows, shops(spark, h1="x"), products(spark)), NOW).collect()}
    field = lambda i, name: next(f.value for f in out[i].fields if f.name == name)
    assert field(0, "Difference") == "€-5.00 (-25.0%)" and field(3, "Difference") == "€1.00 (+0.0%)"
    assert field(1, "Old Price") == "N/A" and field(1, "Difference") == "N/A" and out[1].title == "📉 Price Changed"
    assert field(2, "Price") == "N/A" and out[2].content == "**s1**\n**Category:** Uncategorized\n**Change:** New product"
    assert len(field(0, "Product")) == 100 and out[0].content.endswith("**Category:** g\n**Change:** Price decreased")
    assert field(0, "Detected") == "2024-01-31 10:00 UTC"


def test_backlog_threshold(spark):
    rows = [(i, 1, 7, "new_product", False, None, None) for i in range(25)] + [(100 + i, 2, 7, "new_product", False, None, None) for i in range(26)]
    rows += [(200, 3, 7, "new_product", False, None, None), (300, 2, 7, "stock_in", False, None, None), (400, 3, 7, "new_product", True, None, None)]
    pending = notify.pending_events(events(spark, rows).withColumn("detected_at", F.lit(NOW).cast("timestamp")))
    first = spark.createDataFrame([(3,)], "competitor_id long")
    assert {r.competitor_id for r in notify.suppressed_events(pending, first, backlog_limit=25).collect()} == {2, 3}
    assert notify.suppressed_events(pending, first, backlog_limit=25).count() == 27
    assert notify.suppressed_events(pending, first).count() == 1
    out = notify.notification_outbox(pending, first, shops(spark), products(spark), NOW, "https://d", backlog_limit=25)
    assert sorted(r.send_after for r in out.collect()) == list(range(26))
    assert notify.notification_outbox(pending, first, shops(spark), products(spark), NOW, "https://d", enabled=False).count() == 0
    done = notify.new_deliveries(pending, first, out, NOW, backlog_limit=25)
    store = f"{spark.conf.get('spark.sql.warehouse.dir')}/outbox-test"
    state.write_outbox(out, done, store, 0)
    assert spark.read.parquet(f"{store}/outbox").count() == 26
    done = spark.read.parquet(f"{store}/deliveries")
    assert done.count() == 53 and notify.pending_events(events(spark, rows), done).count() == 0


def test_due_set(spark):
    at = lambda h, m=0: datetime(2024, 1, 31, h, m)
    rows = [(1, True, 60, None), (2, True, 60, at(9, 30)), (3, True, 60, at(8)), (4, True, 0, at(8, 59)), (5, True, None, at(9, 1)), (6, False, 60, None), (7, True, 60, at(1)),
            (8, True, 60, at(1)), (9, True, 60, at(9))]
    competitors = spark.createDataFrame(rows, "id long, active boolean, scan_frequency_minutes int, last_scan_at timestamp")
    runs = spark.createDataFrame([(7, "running", at(9, 45)), (7, "running", at(9, 50)), (8, "running", at(9, 15)), (3, "failed", at(9, 59))],
                                 "competitor_id long, status string, started_at timestamp")
    assert sorted(r.id for r in notify.due_competitors(competitors, runs, NOW).collect()) == [1, 3, 4, 8]


def test_summary_text(spark):
    summary = spark.createDataFrame([(1, 2, 3, 4)], "new_products_today long, price_changes_today long, failed_scans long, competitors_scanned long")
    drops = spark.createDataFrame([("B", Decimal("5.00"), Decimal("1.00"), 1), ("C", Decimal("9.00"), Decimal("8.50"), 2)],
                                  "title string, old_price decimal(12,2), new_price decimal(12,2), pos long")
    out = notify.summary_fanout(summary, shops(spark, h1="x", h2="x", h3=""), "d", drops).collect()
    assert sorted(r.webhook_url for r in out) == ["d", "x"]
    assert out[0].biggest_drops == "• B: $5.00 → $1.00\n• C: $9.00 → $8.50"
