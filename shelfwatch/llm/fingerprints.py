"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

A shingle is a run of `SHINGLE` code points of the text as it is. Sketches of different documents keep the same hashes, so their
overlap estimates likeness and containment between texts of any lengths, and the union of two sketches is the sketch of the
documents together. A fingerprint writes the kept hashes, cut to 32 bits, in order as hexadecimal digits.

Defined cases: a null text is an empty one; a text shorter than a shingle is one shingle; a sketch may be empty, and then is like
that of an equal text only; documents follow each other by falling doc_id, null ids last, equal ids by a hash of the text; a
single document follows itself; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.charclass import code_points
from shelfwatch.llm.common import table

SHINGLE = 8
FRACTION_BITS = 4  # one hash of 2**4 is kept
SLICE_CHARS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """The hash of the SHINGLE points from each place on, by doubling the length of the hashed run."""
    h, length, power = points.astype(np.uint64) + np.uint64(1), 1, BASE
    while length < SHINGLE:
        h = h[:-length] * power + h[length:]
        length, power = length * 2, power * power
    return mix(h)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sketch of every text: sorted distinct 32-bit numbers."""
    padded = [t if len(t) >= SHINGLE or not t else t + "\0" * (SHINGLE - len(t)) for t in texts]
    ends = np.cumsum([len(p) for p in padded])
    if not len(ends) or ends[-1] < SHINGLE:
        return [np.empty(0, np.uint32) for _ in texts]
    with np.errstate(over="ignore"):
        hashes = shingle_hashes(code_points("".join(padded)))
    kept = np.flatnonzero(hashes < np.uint64(1 << (64 - FRACTION_BITS)))
    owner = np.searchsorted(ends, kept, side="right")
    inside = kept + SHINGLE <= ends[owner]
    kept, owner = kept[inside], owner[inside]
    key = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (hashes[kept] >> np.uint64(32 - FRACTION_BITS)))
    bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    values = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    """Estimated share of all shingles of both that both have; `equal` tells of equal texts, whose sketches may be empty."""
    if equal:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, extra, doc_id, order_hash, text), partitioned and sorted so that each row's successor is the row after it.

    The documents are dealt to ranges of doc_id between splitters, which are quantiles of the ids. The first row of every range is
    also put at the end of the range before, marked as extra, and the very first one at the end of the last range. Only
    the splitters and one id per range pass through the driver.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = buckets or 4 * parts
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    splitters = plain.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    cuts = F.array(*(F.lit(c).cast("long") for c in sorted(set(splitters or [])))) if splitters else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(F.size(F.filter(cuts, lambda c: c > F.col("doc_id"))))
    keyed = plain.withColumns({"bucket": bucket, "order_hash": F.xxhash64("text")})
    first = keyed.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("id"), "order_hash")).alias("first")).orderBy("bucket").collect()
    if not first:
        return keyed.withColumn("extra", F.lit(False))
    goes_to = [first[i - 1]["bucket"] for i in range(len(first))]  # the first range's own goes to the last
    rows = [(r["bucket"], None if r["first"]["id"] is None else -r["first"]["id"], r["first"]["order_hash"], to) for r, to in zip(first, goes_to)]
    heads = spark.createDataFrame(rows, "b int, head long, head_hash long, before int")  # one row per range
    joined = keyed.join(F.broadcast(heads), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("order_hash") == F.col("head_hash")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    spread = joined.select("doc_id", "order_hash", "text", F.explode(places).alias("place")).select("place.*", "doc_id", "order_hash", "text")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "order_hash")


def pairs_of(batches):
    """(doc_id, text, next text) from the rows of `with_next`."""
    held = None
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                if held is not None and held[0] == row[0]:
                    yield held[2], held[3], row[3]
                held = None if row[1] else row


FINGERPRINT_FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced by the beginning of the next document."""

    def build(pairs: list[tuple]):
        edited = []
        for _, text, following in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + following[:half])
        own, other, after = (sketches(t) for t in ([p[1] for p in pairs], edited, [p[2] for p in pairs]))
        columns = zip(*(
            (p[0], len(p[1]), hashlib.sha256(e.encode()).hexdigest(), fingerprint(a), fingerprint(b), likeness(a, b, p[1] == e), likeness(a, c, p[1] == p[2]))
            for p, e, a, b, c in zip(pairs, edited, own, other, after)
        ))
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        fields = [f.split() for f in FINGERPRINT_FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    def run(batches):
        pairs, size = [], 0
        for pair in pairs_of(batches):
            pairs.append(pair)
            size += len(pair[1])
            if size >= SLICE_CHARS:
                yield build(pairs)
                pairs, size = [], 0
        if pairs:
            yield build(pairs)

    return with_next(docs, buckets).mapInArrow(run, FINGERPRINT_FIELDS)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))
