"""The bucketed store: what a batch touches, compaction and expiry, hand-overs, and scans of a stream in order."""

import glob
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwatch.schemas import ITEM_SCHEMA, SCAN_SCHEMA
from shelfwatch.sinks import outbox, state, views
from shelfwatch.streaming import scans as streams

BUCKETS = 16


def landed(spark, *rows):
    """(shop, url, price) as items."""
    full = [(c, i, u, None, f"Item {u}", None if p is None else Decimal(p), "USD", "in_stock", None, None, "g") for i, (c, u, p) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM_SCHEMA)


def scanned(spark, *shops):
    return spark.createDataFrame([(c, False) for c in shops], SCAN_SCHEMA)


def write(spark, folder, rows, shops, day="2024-01-01", batch=None, **more):
    return state.write_scan(spark, folder, batch, landed(spark, *rows), scanned(spark, *shops), f"{day} 00:00:00", buckets=BUCKETS, **more)


def test_a_batch_touches_the_buckets_of_its_shops_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    write(spark, folder, [(c, f"u{c}", "1") for c in range(12)], range(12))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/buckets/**/*.parquet", recursive=True)}
    read = []
    plain = state.read_buckets
    monkeypatch.setattr(state, "read_buckets", lambda *a: read.append(plain(*a).inputFiles()) or plain(*a))
    write(spark, folder, [(3, "u3", "2")], [3])
    monkeypatch.undo()
    own = spark.createDataFrame([(3,)], "competitor_id long").select(state.shop_bucket(BUCKETS)).first()[0]
    assert read[-1] and all(f"bucket={own}/" in f for f in read[-1])
    assert {os.path.basename(os.path.dirname(f)) for f in glob.glob(f"{folder}/buckets/version=1/**/*.parquet", recursive=True)} == {f"bucket={own}"}
    assert {f: os.stat(f).st_mtime_ns for f in before} == before
    prices = {r.competitor_id: r.price for r in state.read_state(spark, folder).collect()}
    assert prices == {c: Decimal("2.00") if c == 3 else Decimal("1.00") for c in range(12)}
    assert state.read_manifest(spark, folder).n_buckets == BUCKETS


def test_logs_without_rows_are_read(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert views.read_events(spark, folder).count() == 0 and state.read_state(spark, folder).count() == 0 and state.compact(spark, folder) is None
    write(spark, folder, [(1, "u", "1")], [1])
    assert views.read_events(spark, folder).count() == 1 and state.read_log(spark, folder, "failures").count() == 0
    write(spark, folder, [(1, "u", "1")], [1])
    assert views.read_events(spark, folder).count() == 1 and views.read_runs(spark, folder).count() == 2


def files(folder, name):
    return glob.glob(f"{folder}/{name}/**/*.parquet", recursive=True)


def test_compaction_keeps_readers_and_bounds_files(spark, tmp_path):
    folder = str(tmp_path / "store")
    for i in range(6):
        write(spark, folder, [(1, "u", str(i + 1))], [1], day=f"2024-01-0{1 + i // 3}")
    reader, old = views.read_events(spark, folder), state.read_state(spark, folder)
    want = sorted((r.batch, r.event_type, str(r.day)) for r in reader.collect())
    manifest = state.compact(spark, folder)
    assert manifest.revision == 1 and all(len(parts) == 2 for parts in manifest.logs.values())
    assert len(views.read_events(spark, folder).inputFiles()) <= 2 * 2  # events and failures, two days
    assert sorted((r.batch, r.event_type, str(r.day)) for r in views.read_events(spark, folder).collect()) == want
    assert state.expire(spark, folder, hours=1) == 0
    assert sorted((r.batch, r.event_type, str(r.day)) for r in reader.collect()) == want and old.count() == 1  # still open
    assert state.expire(spark, folder, hours=-1) > 0
    assert len(files(folder, "events")) <= 2 and len(files(folder, "buckets")) == 1 and len(state.folder_names(spark, f"{folder}/state")) == 1
    assert sorted((r.batch, r.event_type, str(r.day)) for r in views.read_events(spark, folder).collect()) == want
    write(spark, folder, [(1, "u", "9")], [1], day="2024-01-02")
    assert state.current_version(spark, folder) == 6 and views.read_events(spark, folder).count() == len(want) + 1
    assert state.read_log(spark, folder, "events", after=5).count() == 1 and state.compact(spark, folder).revision == 1


def test_what_is_in_the_making_is_not_expired(spark, tmp_path):
    folder = str(tmp_path / "store")
    write(spark, folder, [(1, "u", "1")], [1])
    os.makedirs(f"{folder}/buckets/version=1/bucket=0")
    os.makedirs(f"{folder}/events/day=2024-01-01/part=b1")
    assert state.expire(spark, folder, hours=-1) == 0 and os.path.exists(f"{folder}/events/day=2024-01-01/part=b1")


# --- hand-overs --------------------------------------------------------------------------------------------

def shops(spark, **hooks):
    rows = [(c, f"shop {c}", hooks.get(f"h{c}"), True) for c in (1, 2)]
    return spark.createDataFrame(rows, "id long, name string, webhook_url string, active boolean")


def test_hand_overs_share_no_second_and_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    none = spark.createDataFrame([], "competitor_id long")
    send = lambda now, **hooks: outbox.hand_over(spark, folder, none, shops(spark, **hooks), views.read_products(spark, folder), now)
    at = lambda rows, now: [(r.webhook_url, int(datetime.fromisoformat(now).timestamp()) + r.send_after) for r in rows]
    write(spark, folder, [(1, f"u{i}", "1") for i in range(5)] + [(2, "v", "1")], [1, 2])
    first = send("2024-01-01 00:00:00", h1="https://one").collect()
    assert sorted(r.send_after for r in first) == list(range(5))  # shop 2 has no webhook yet
    write(spark, folder, [(1, f"u{i}", "2") for i in range(5)], [1])
    assert all("part=b1/" in f or "/waiting/" in f for f in outbox.read_pending(spark, folder).inputFiles())
    second = send("2024-01-01 00:00:02", h1="https://one", h2="https://two").collect()
    assert Counter(r.event_type for r in second) == {"price_increase": 5, "new_product": 1}
    assert sorted(r.send_after for r in second if r.webhook_url == "https://one") == [3, 4, 5, 6, 7]
    seconds = at(first, "2024-01-01 00:00:00") + at(second, "2024-01-01 00:00:02")
    assert len(seconds) == len(set(seconds)) == 11
    third = send("2024-01-01 01:00:00", h1="https://one").collect()
    assert third == [] and outbox.read_pending(spark, folder).count() == 0
    assert {r.webhook_url for r in outbox.read_clock(spark, folder).collect()} == {"https://one", "https://two"}


def test_a_hand_over_that_died_is_done_again(spark, tmp_path):
    folder, none = str(tmp_path / "store"), spark.createDataFrame([], "competitor_id long")
    write(spark, folder, [(1, "u", "1")], [1])
    send = lambda: outbox.hand_over(spark, folder, none, shops(spark, h1="x"), views.read_products(spark, folder), "2024-01-01 00:00:00")
    assert send().count() == 1
    os.remove(f"{folder}/handed/batch=0/_SUCCESS")
    assert send().count() == 1 and outbox.last_hand_over(spark, folder) == (0, 0) and send().count() == 0


# --- scans of a stream in order ----------------------------------------------------------------------------

class Feed:
    """A marked stream over files, run to its end after every landing."""

    def __init__(self, spark, folder, hold=10**9):
        self.spark, self.source, self.folder, self.cp, self.hold = spark, f"{folder}/in", f"{folder}/store", f"{folder}/cp", hold

    def land(self, shop, scan, rows, end=None):
        items = landed(self.spark, *[(shop, u, p) for _, u, p in rows]).drop("item_ix")
        numbers = self.spark.createDataFrame([(u, ix) for ix, u, _ in rows] or [("", 0)], "url string, item_ix long")
        frame = items.join(numbers, "url").withColumns({"scan_id": F.lit(scan).cast("long"), "scan_end": F.lit(None).cast("long")})
        if end is not None:
            marker = self.spark.createDataFrame([(shop, scan, end)], "competitor_id long, scan_id long, scan_end long")
            frame = frame.unionByName(marker, allowMissingColumns=True)
        names = [f.split()[0] for f in streams.OPEN_SCHEMA.split(", ")]
        frame.select(*names).coalesce(1).write.mode("append").parquet(self.source)
        self.run()

    def run(self):
        stream = self.spark.readStream.schema(streams.OPEN_SCHEMA).parquet(self.source)
        streams.scan_stream(stream, self.folder, self.cp, lambda n: "2024-01-01 00:00:00", hold=self.hold, lateness="0 seconds").awaitTermination()

    def prices(self):
        return {r.url: r.price for r in state.read_state(self.spark, self.folder).collect()}


def test_scans_are_applied_in_order(spark, tmp_path):
    """The end of scan 2 comes before that of scan 1; a redelivered and a late scan change nothing."""
    feed = Feed(spark, str(tmp_path))
    feed.land(1, 1, [(0, "a", "10")])
    feed.land(1, 2, [(0, "a", "20"), (1, "b", "5")], end=2)
    assert state.current_version(spark, feed.folder) is None  # scan 2 is closed, scan 1 is not
    feed.land(1, 1, [], end=1)
    assert feed.prices() == {"a": Decimal("20.00"), "b": Decimal("5.00")}
    kinds = Counter(r.event_type for r in state.read_log(spark, feed.folder, "events").collect())
    assert kinds == {"new_product": 2, "price_increase": 1} and state.current_version(spark, feed.folder) == 1
    feed.land(1, 2, [(0, "a", "20"), (1, "b", "5")], end=2)
    feed.land(1, 0, [(0, "a", "1")], end=1)
    assert feed.prices() == {"a": Decimal("20.00"), "b": Decimal("5.00")} and state.current_version(spark, feed.folder) == 1
    assert {(r.scan_id, r.kind) for r in streams.refused_scans(spark, feed.folder).collect()} == {(0, "late"), (2, "late")}
    batch = str(tmp_path / "batch")
    write(spark, batch, [(1, "a", "10")], [1])
    write(spark, batch, [(1, "a", "20"), (1, "b", "5")], [1])
    columns = ["url", "price", "active", "consecutive_misses", "product_id"]
    rows = lambda place: sorted(state.read_state(spark, place).select(columns).collect())
    assert rows(feed.folder) == rows(batch)


def test_a_scan_that_never_ends_is_given_up(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), hold=1)
    feed.land(1, 1, [(0, "a", "10")])
    feed.land(1, 2, [(0, "a", "20")], end=1)
    feed.land(2, 1, [(0, "z", "1")], end=1)  # the next micro-batch, after the time
    assert feed.prices() == {"a": Decimal("20.00"), "z": Decimal("1.00")}
    feed.land(1, 1, [], end=1)
    assert feed.prices()["a"] == Decimal("20.00")
    assert {(r.competitor_id, r.scan_id) for r in streams.refused_scans(spark, feed.folder).where("kind = 'given up'").collect()} == {(1, 1)}
