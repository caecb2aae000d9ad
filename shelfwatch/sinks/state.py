"""The stored catalog in buckets, append-only logs by day, and the manifest that makes a batch visible.

    state/batch=N/              the manifest of batch N: one line of JSON, complete when `_SUCCESS` is beside it
    buckets/version=N/bucket=b/ the rows of bucket b as batch N left them
    events/day=D/part=bN/       a log's rows of batch N; likewise snapshots, runs and failures

A shop belongs to one bucket. A batch reads and rewrites the buckets of the scanned shops only; the manifest maps every bucket to the version
that holds it, and every log to the parts that count. It is written last, so a batch that dies leaves the one before current and writes over its own
folders when it is run again. `compact` merges the parts of a day and publishes a manifest `batch=N.r` of its own; what nothing refers to any more is
deleted by `expire` after a set time, so that readers that hold an older manifest aren't disturbed. There is one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.operators.detect import ScanResult, apply_scan, failure_events, scan_runs, scan_summary
from shelfwatch.schemas import LOG_SCHEMAS, STATE_SCHEMA

#: Buckets of a new store; a store keeps the number that it was begun with.
BUCKETS = 256


@dataclass(frozen=True)
class Manifest:
    """What a batch made visible: versions by bucket, (day, part) by log, and how far each named source has come."""

    batch: int
    revision: int = 0
    n_buckets: int = BUCKETS
    buckets: dict[str, int] = field(default_factory=dict)
    logs: dict[str, list[list[str]]] = field(default_factory=dict)
    sources: dict[str, list[int]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"batch={self.batch}.{self.revision}" if self.revision else f"batch={self.batch}"


# --- folders -----------------------------------------------------------------------------------------------

def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder with their times of change in milliseconds; empty where there is no folder."""
    target, fs = _path(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(target)} if fs.exists(target) else {}


def is_complete(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


def newest_complete(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """The folder `batch=N` or `batch=N.r` with the highest number (below `before`) that was written to its end. One listing."""
    named = []
    for name in folder_names(spark, path):
        if name.startswith("batch="):
            batch, _, revision = name.removeprefix("batch=").partition(".")
            if before is None or int(batch) < before:
                named.append((int(batch), int(revision or 0), name))
    return next((name for *_, name in sorted(named, reverse=True) if is_complete(spark, f"{path}/{name}")), None)


def write_line(spark: SparkSession, path: str, value: dict) -> None:
    """One line of JSON in a folder of its own; `_SUCCESS` is put beside it when it is whole."""
    for name, text in (("line.json", json.dumps(value)), ("_SUCCESS", "")):
        target, fs = _path(spark, f"{path}/{name}")
        stream = fs.create(target, True)
        stream.write(text.encode())
        stream.close()


def read_line(spark: SparkSession, path: str) -> dict:
    target, fs = _path(spark, f"{path}/line.json")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_manifest(spark: SparkSession, folder: str, before: int | None = None) -> Manifest | None:
    """The current manifest, or the one that a batch numbered `before` starts from."""
    name = newest_complete(spark, f"{folder}/state", before)
    return None if name is None else Manifest(**read_line(spark, f"{folder}/state/{name}"))


def publish(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    write_line(spark, f"{folder}/state/{manifest.name}", asdict(manifest))


def current_version(spark: SparkSession, folder: str) -> int | None:
    manifest = read_manifest(spark, folder)
    return None if manifest is None else manifest.batch


# --- reading -----------------------------------------------------------------------------------------------

def shop_bucket(n: int):
    """The bucket of a competitor_id column."""
    return F.pmod(F.xxhash64(F.col("competitor_id").cast("long")), F.lit(n)).cast("int")


def read_buckets(spark: SparkSession, folder: str, manifest: Manifest | None, buckets: list[int] | None = None) -> DataFrame:
    """The state as a manifest has it, of all or some buckets."""
    held = {} if manifest is None else manifest.buckets
    paths = [f"{folder}/buckets/version={v}/bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(*paths)


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The current state, or the one a batch numbered `before` starts from."""
    return read_buckets(spark, folder, read_manifest(spark, folder, before))


def part_limit(part: str) -> int:
    """The highest batch whose rows a part may hold."""
    return int(part[1:].partition(".")[0])


def read_log(spark: SparkSession, folder: str, name: str, after: int | None = None) -> DataFrame:
    """Rows of all committed batches, or of those above `after`, of `events`, `snapshots`, `runs` or `failures`; `day` is a partition column."""
    schema = f"{LOG_SCHEMAS[name]}, batch int, day date"
    manifest = read_manifest(spark, folder)
    parts = [] if manifest is None else manifest.logs.get(name, [])
    paths = [f"{folder}/{name}/day={day}/part={part}" for day, part in parts if after is None or part_limit(part) > after]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, part string").option("basePath", f"{folder}/{name}").parquet(*paths).drop("part")
    return rows if after is None else rows.where(F.col("batch") > after)


# --- writing -----------------------------------------------------------------------------------------------

def _fitted(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.DataType.fromDDL(schema).fields])


def write_scan(
    spark: SparkSession, folder: str, batch: int | None, items: DataFrame, scans: DataFrame, now, errors: DataFrame | None = None,
    token: tuple[str, list[int]] | None = None, buckets: int = BUCKETS,
) -> ScanResult | None:
    """Apply one scan batch to the stored state and write all its outputs.

    A batch given by number is skipped if that number or a later one is committed. Without a number it takes the next one, and is
    skipped only if the source that its `token` names has come as far as the token's numbers say. `buckets` counts for a new store.
    """
    newest = read_manifest(spark, folder)
    if batch is None:
        if token is not None and newest is not None and newest.sources.get(token[0], [-1]) >= list(token[1]):
            return None
        batch = 0 if newest is None else newest.batch + 1
    elif newest is not None and batch <= newest.batch:
        return None
    base = newest or Manifest(batch=-1, n_buckets=buckets)
    bucket = shop_bucket(base.n_buckets)
    # at most as many numbers as there are buckets
    touched = [r.bucket for r in scans.select(bucket.alias("bucket")).distinct().collect()]
    result = apply_scan(read_buckets(spark, folder, newest, touched), items, scans, now, keep_sequence=True, errors=errors)
    runs = scan_runs(result.scans, scan_summary(result.sequence), errors, now)
    logs = {"snapshots": result.snapshots, "events": result.events, "runs": runs, "failures": failure_events(runs)}
    day, part = datetime.fromisoformat(str(now)).date().isoformat(), f"b{batch}"
    for name, rows in logs.items():
        stamped = _fitted(rows, LOG_SCHEMAS[name]).withColumn("batch", F.lit(batch))
        stamped.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{name}/day={day}/part={part}")
    version = f"{folder}/buckets/version={batch}"
    # a large bucket is split and small ones are merged into files by the hint
    result.state.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
    written = {n.removeprefix("bucket="): batch for n in folder_names(spark, version) if n.startswith("bucket=")}
    publish(spark, folder, replace(
        base, batch=batch, revision=0,
        buckets={b: v for b, v in base.buckets.items() if int(b) not in touched} | written,
        logs={name: [*base.logs.get(name, []), [day, part]] for name in logs},
        sources=base.sources | ({token[0]: list(token[1])} if token else {}),
    ))
    return result


def write_outbox(outbox: DataFrame, deliveries: DataFrame, folder: str, batch: int) -> None:
    """Hand messages over: the outbox rows, then the deliveries that keep their events from being sent again."""
    outbox.write.mode("overwrite").parquet(f"{folder}/outbox/batch={batch}")
    deliveries.write.mode("overwrite").parquet(f"{folder}/deliveries/batch={batch}")


# --- upkeep ------------------------------------------------------------------------------------------------

def compact(spark: SparkSession, folder: str) -> Manifest | None:
    """Merge the parts of every day of every log, publish a manifest that refers to the merged ones, and return it.

    Nothing is deleted, so whoever reads by an older manifest goes on reading.
    """
    base = read_manifest(spark, folder)
    if base is None or all(len(days) == len({d for d, _ in days}) for days in base.logs.values()):
        return base
    merged, revision = {}, base.revision + 1
    for name, parts in base.logs.items():
        by_day: dict[str, list[str]] = {}
        for day, part in parts:
            by_day.setdefault(day, []).append(part)
        merged[name] = [[day, some[0] if len(some) == 1 else f"c{max(map(part_limit, some))}.{revision}"] for day, some in by_day.items()]
        for day, some in by_day.items():
            if len(some) > 1:
                rows = spark.read.schema(f"{LOG_SCHEMAS[name]}, batch int").parquet(*[f"{folder}/{name}/day={day}/part={p}" for p in some])
                rows.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{name}/day={day}/part=c{max(map(part_limit, some))}.{revision}")
    manifest = replace(base, revision=revision, logs=merged)
    publish(spark, folder, manifest)
    return manifest


def expire(spark: SparkSession, folder: str, hours: float) -> int:
    """Delete manifests that were replaced more than `hours` ago, and folders that none of the others refers to; how many were deleted.

    Folders of batches above the newest manifest may be in the making and stay.
    """
    newest = read_manifest(spark, folder)
    if newest is None:
        return 0
    cutoff = datetime.now().timestamp() * 1000 - hours * 3_600_000
    names = folder_names(spark, f"{folder}/state")
    kept, gone = [newest], []
    for name, changed in names.items():
        if name == newest.name or not name.startswith("batch=") or part_limit(f"b{name.removeprefix('batch=')}") > newest.batch:
            continue
        if changed < cutoff:
            gone.append(f"state/{name}")
        elif is_complete(spark, f"{folder}/state/{name}"):
            kept.append(Manifest(**read_line(spark, f"{folder}/state/{name}")))
    used = {f"buckets/version={v}/bucket={b}" for m in kept for b, v in m.buckets.items()}
    used |= {f"{name}/day={day}/part={part}" for m in kept for name, parts in m.logs.items() for day, part in parts}
    for version, changed in folder_names(spark, f"{folder}/buckets").items():
        if part_limit(f"b{version.removeprefix('version=')}") <= newest.batch and changed < cutoff:
            inside = {f"buckets/{version}/{b}" for b in folder_names(spark, f"{folder}/buckets/{version}") if b.startswith("bucket=")}
            gone += inside - used if inside & used else [f"buckets/{version}"]
    for name in LOG_SCHEMAS:
        for day in folder_names(spark, f"{folder}/{name}"):
            for part, changed in folder_names(spark, f"{folder}/{name}/{day}").items():
                path = f"{name}/{day}/{part}"
                if part.startswith("part=") and part_limit(part.removeprefix("part=")) <= newest.batch and changed < cutoff and path not in used:
                    gone.append(path)
    for path in gone:
        target, fs = _path(spark, f"{folder}/{path}")
        fs.delete(target, True)
    return len(gone)
