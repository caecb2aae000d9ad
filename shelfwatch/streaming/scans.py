"""Continuous forms of the jobs: scan batches, item-level changes and windowed counts."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from shelfwatch.operators.dashboard import SOLD
from shelfwatch.schemas import ITEM_SCHEMA
from shelfwatch.session import cut_lineage
from shelfwatch.sinks.state import shop_bucket, write_scan
from shelfwatch.sources.catalogs import dedupe_catalog

CHANGE_SCHEMA = (
    "competitor_id long, product_key string, scan_no long, event_type string, old_price decimal(12,2), price decimal(12,2), "
    "old_stock string, stock_status string"
)


#: Columns of a stream whose scans may be larger than a micro-batch: the scan of an item, rising in time per shop, and, in the row that
#: ends a scan, how many items (distinct item_ix) it has; the row holds no item itself. In rows of items the number is null.
SCAN_MARKS = "scan_id long, scan_end long"
OPEN_SCHEMA = f"{ITEM_SCHEMA}, {SCAN_MARKS}"
LANDED_SCHEMA = f"{OPEN_SCHEMA}, landed_at timestamp, bucket int"
LANDED_BUCKETS = 64
#: Arrived items are kept as bitmaps of so many item numbers.
BLOCK_BITS = 8192
ARRIVAL_SCHEMA = "competitor_id long, scan_id long, block long, bits binary, scan_end long, landed_at timestamp"
RELEASE_SCHEMA = "competitor_id long, scan_id long, kind string, turn long"


def land_items(items: DataFrame, landing: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Every row of a marked stream written once, by bucket of its shop, where its scan is read from when its turn has come."""
    names = [f.split()[0] for f in OPEN_SCHEMA.split(", ")]
    rows = items.select(*names).withColumns({"landed_at": F.current_timestamp(), "bucket": shop_bucket(LANDED_BUCKETS)})
    return rows.writeStream.format("parquet").partitionBy("bucket").option("path", landing).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def arrivals(rows: DataFrame) -> DataFrame:
    """(competitor_id, scan_id, block, bits, scan_end, landed_at): which item numbers have arrived, as bitmaps, and the ends of scans.

    A batch of rows gives a bitmap per block of a scan, so that a large scan is little for the processor of its shop.
    """

    def run(batches):
        for batch in batches:
            frame, kind = batch.to_pandas(), batch.schema.field("landed_at").type
            out = []
            for (shop, scan, block), some in frame[frame.item_ix.notna()].assign(block=lambda f: f.item_ix // BLOCK_BITS).groupby(["competitor_id", "scan_id", "block"]):
                bits = np.zeros(BLOCK_BITS, bool)
                bits[(some.item_ix.astype("int64") % BLOCK_BITS).to_numpy()] = True
                out.append((int(shop), int(scan), int(block), np.packbits(bits).tobytes(), None, some.landed_at.max()))
            for shop, scan, end, landed in frame.loc[frame.scan_end.notna(), ["competitor_id", "scan_id", "scan_end", "landed_at"]].itertuples(index=False):
                out.append((int(shop), int(scan), None, None, int(end), landed))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in ARRIVAL_SCHEMA.split(", ")])

    marks = rows.where("competitor_id is not null and scan_id is not null")
    # the row that ends a scan holds no item
    marks = marks.select("competitor_id", "scan_id", F.when(F.col("scan_end").isNull(), F.col("item_ix")).alias("item_ix"), "scan_end", "landed_at")
    return marks.mapInArrow(run, ARRIVAL_SCHEMA)


class ScanOrder(StatefulProcessor):
    """Releases the scans of a shop in the order of their ids.

    A scan is closed when its end and all its items have arrived. A closed scan waits for older scans of its shop that are open; those are given up by a
    timer, once anything has landed more than `hold` milliseconds later. Rows of a scan that was released or given up before, or is older than one that was, release nothing: it is told as late.
    The state of a shop is a bitmap per block of the scans that are open, and the id of the last scan that is settled.
    """

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "scan_id long")
        self.arrived = handle.getMapState("arrived", "scan_id long", "n long")
        self.ends = handle.getMapState("ends", "scan_id long", "n long")
        self.blocks = handle.getMapState("blocks", "scan_id long, block long", "bits binary")

    def known(self) -> list[int]:
        return sorted({k[0] for k in self.arrived.keys()} | {k[0] for k in self.ends.keys()})

    def closed(self, scan: int) -> bool:
        if not self.ends.containsKey((scan,)):
            return False
        return (self.arrived.getValue((scan,))[0] if self.arrived.containsKey((scan,)) else 0) >= self.ends.getValue((scan,))[0]

    def settle(self, scan: int) -> None:
        for state in (self.arrived, self.ends):
            if state.containsKey((scan,)):
                state.removeKey((scan,))
        for key in [k for k in self.blocks.keys() if k[0] == scan]:
            self.blocks.removeKey(tuple(key))
        self.settled.update((scan,))

    def release(self, give_up: bool, landed: int) -> list[tuple]:
        """The scans whose turn has come; with `give_up` also those behind open ones, which are given up."""
        scans = self.known()
        closed = [s for s in scans if self.closed(s)]
        ready = closed if give_up else list(itertools.takewhile(lambda s: s in closed, scans))
        out, turn = [], 0
        for scan in [s for s in scans if ready and s <= ready[-1]]:
            turn += scan in ready
            out.append((scan, "apply" if scan in ready else "given up", turn if scan in ready else None))
            self.settle(scan)
        timers = list(self.handle.listTimers())
        waiting = len(closed) > len(ready)
        if waiting and not timers:
            self.handle.registerTimer(landed + self.hold)
        elif not waiting:
            for timer in timers:
                self.handle.deleteTimer(timer)
        return out

    def told(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame([(key[0], *r) for r in rows], columns=["competitor_id", "scan_id", "kind", "turn"])
        yield frame.astype({"turn": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.settled.get()[0] if self.settled.exists() else None
        late, landed = set(), 0
        for frame in rows:
            landed = max(landed, int(frame.landed_at.max().timestamp() * 1000))
            for scan, block, bits, end in frame[["scan_id", "block", "bits", "scan_end"]].itertuples(index=False):
                scan = int(scan)
                if last is not None and scan <= last:
                    late.add(scan)
                elif bits is None:
                    self.ends.updateValue((scan,), (int(end),))
                else:
                    place = (scan, int(block))
                    before = np.frombuffer(bytes(self.blocks.getValue(place)[0]), np.uint8) if self.blocks.containsKey(place) else np.zeros(BLOCK_BITS // 8, np.uint8)
                    now = before | np.frombuffer(bits, np.uint8)
                    more = int(np.bitwise_count(now).sum()) - int(np.bitwise_count(before).sum())
                    count = self.arrived.getValue((scan,))[0] if self.arrived.containsKey((scan,)) else 0
                    self.arrived.updateValue((scan,), (count + more,))
                    self.blocks.updateValue(place, (now.tobytes(),))
        released = self.release(False, landed)
        yield from self.told(key, released + [(scan, "late", None) for scan in sorted(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.told(key, self.release(True, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def released_scans(rows: DataFrame, hold: int, lateness: str) -> DataFrame:
    """(competitor_id, scan_id, kind, turn) of a marked stream: scans to apply in turn, given up, or late. Needs the RocksDB state store provider.

    The clock is the time of landing, so that a stream that is run from time to time ends. `lateness` allows for clocks that differ between runs.
    """
    return arrivals(rows).withWatermark("landed_at", lateness).groupBy("competitor_id").transformWithStateInPandas(
        statefulProcessor=ScanOrder(hold), outputStructType=RELEASE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def refused_scans(spark: SparkSession, folder: str) -> DataFrame:
    """(competitor_id, scan_id, kind) of the scans that streams did not apply: late ones, and those given up."""
    return spark.read.schema(f"{RELEASE_SCHEMA}, query string, batch long").parquet(f"{folder}/refused").select("competitor_id", "scan_id", "kind").distinct()


def scan_stream(
    items: DataFrame, folder: str, checkpoint: str, clock, by_external_id: bool = False, hold: int = 600_000, lateness: str = "1 minute",
    trigger: dict | None = None,
) -> StreamingQuery:
    """A stream of landed items applied scan by scan to the stored state, first item per catalog key.

    With the columns of `SCAN_MARKS` a scan is applied, and its misses counted, when its end and all its items have arrived, in whatever order and
    over any number of micro-batches, and after the older scans of its shop. Its rows are written once, under `folder`; a first query lands them and the returned
    one, which counts them, applies scans (`ScanOrder`; `hold` is how many milliseconds a scan waits for older open ones). A scan that arrives after a
    newer one of its shop was applied changes nothing and is found in `refused_scans`. A stream without these columns declares that
    every micro-batch holds whole scans of its shops.

    A micro-batch is named by the query's id, which is kept in its checkpoint, and its number: delivered again it is recognised
    and skipped, while a new checkpoint, another stream or a batch job before it take versions of their own. `clock(number)` is
    the time of a batch, in UTC.
    """
    spark, trigger = items.sparkSession, trigger or {"availableNow": True}

    def query_id(place: str) -> str:
        return json.loads(spark.read.text(f"{place}/metadata").first()[0])["id"]

    def write(rows: DataFrame, scanned: DataFrame, number: int, token: tuple) -> None:
        scans = scanned.select("competitor_id").distinct().withColumn("allow_empty", F.lit(False))
        write_scan(spark, folder, None, dedupe_catalog(rows, by_external_id), scans, clock(number), token=token)

    def apply_whole(batch: DataFrame, number: int) -> None:
        write(batch, batch, number, (query_id(checkpoint), [number]))

    if not {"scan_id", "scan_end"} <= set(items.columns):
        return items.writeStream.foreachBatch(apply_whole).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    landing = f"{folder}/landed/{hashlib.md5(checkpoint.encode()).hexdigest()}"
    landed = land_items(items, landing, f"{checkpoint}/landing", trigger)
    if trigger.get("availableNow"):
        landed.awaitTermination()

    def apply_released(batch: DataFrame, number: int) -> None:
        query = query_id(f"{checkpoint}/order")
        # written once: the processor must not run again for every turn
        released = cut_lineage(batch.withColumn("bucket", shop_bucket(LANDED_BUCKETS)))
        released.where("kind <> 'apply'").drop("bucket").write.mode("overwrite").parquet(f"{folder}/refused/query={query}/batch={number}")
        due = released.where("kind = 'apply'")
        span = due.agg(F.max("turn"), F.min("scan_id"), F.max("scan_id"), F.collect_set("bucket")).first()
        for turn in range(1, (span[0] or 0) + 1):
            scanned = due.where(F.col("turn") == turn).select("competitor_id", "scan_id")
            rows = spark.read.schema(LANDED_SCHEMA).parquet(landing).where(F.col("bucket").isin(span[3]) & F.col("scan_id").between(span[1], span[2]))
            whole = rows.where("scan_end is null").join(scanned, ["competitor_id", "scan_id"], "left_semi").drop("scan_id", "scan_end", "landed_at", "bucket")
            write(whole, scanned, number, (query, [number, turn]))

    rows = spark.readStream.schema(LANDED_SCHEMA).parquet(landing)
    return released_scans(rows, hold, lateness).writeStream.foreachBatch(apply_released).option("checkpointLocation", f"{checkpoint}/order").trigger(**trigger).start()


class ItemChanges(StatefulProcessor):
    """Price and stock changes per (competitor, product): the state is the last price and stock status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price decimal(12,2), stock_status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("scan_no")
        known = self.last.exists()
        price, stock = self.last.get() if known else (None, None)
        out = []
        for row in batch.itertuples(index=False):
            new_price = None if pd.isna(row.price) else row.price
            if not known:
                out.append((*key, row.scan_no, "new_product", None, new_price, None, row.stock_status))
            else:
                if price != new_price:
                    if price is None or new_price is None:
                        kind = "price_changed"
                    else:
                        kind = "price_increase" if new_price > price else "price_decrease"
                    out.append((*key, row.scan_no, kind, price, new_price, None, None))
                if stock != row.stock_status:
                    kind = "stock_in" if row.stock_status == "in_stock" else "stock_out"
                    out.append((*key, row.scan_no, kind, None, None, stock, row.stock_status))
            price, stock, known = new_price, row.stock_status, True
        self.last.update((price, stock))
        names = [part.strip().split()[0] for part in CHANGE_SCHEMA.replace("(12,2)", "").split(",")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def item_changes(items: DataFrame) -> DataFrame:
    """Events of a stream of (competitor_id, product_key, scan_no, price, stock_status), in scan order per product.

    Needs the RocksDB state store provider. The state is two values per product.
    """
    return items.groupBy("competitor_id", "product_key").transformWithStateInPandas(
        statefulProcessor=ItemChanges(), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="None"
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Event counts per window and type over a stream; events later than `lateness` are dropped.

    The event time is cast first because a watermark needs a TIMESTAMP.
    """
    stamped = events.withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    return (
        stamped.withWatermark("detected_at", lateness)
        .groupBy(F.window("detected_at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )




def windowed_sales(events: DataFrame, width: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Sale signals per window and competitor over a stream or a table: how many, of how many distinct products, and the last one.

    Signals are counted per product first, so a competitor with most of the events is spread over its products and no set of products is held
    as one value; the state is one row per (window, competitor, product) until the window closes.
    """
    stamped = events.where(F.col("event_type") == SOLD).withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    # signals without a product count as signals
    products = stamped.withWatermark("detected_at", lateness).groupBy(F.window("detected_at", width).alias("w"), "competitor_id", "product_id").agg(
        F.count("*").alias("n"), F.max("detected_at").alias("last"))
    shops = products.groupBy(F.window(F.window_time("w"), width).alias("w"), "competitor_id").agg(
        F.sum("n").alias("inferred_sold_count"), F.count("product_id").alias("unique_products_count"), F.max("last").alias("last_signal_at"))
    return shops.select(F.col("w.start").alias("window_start"), "competitor_id", "inferred_sold_count", "unique_products_count", "last_signal_at")
