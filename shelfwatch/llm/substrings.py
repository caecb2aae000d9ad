"""Repeated substrings by sorting suffixes.

Every byte that lies in a string of `LENGTH` bytes which also starts anywhere else is found. Not all suffixes are sorted: of
each run of LENGTH bytes the suffix that starts with its smallest `LEAD`-byte hash is its anchor, so equal strings have their
anchor at the same place, and suffixes at anchors stand for all others. An anchor's record has the bytes around it that any string
of LENGTH bytes with this anchor can have. Records whose lead occurs only once are dropped by a first, narrow pass. The others are
range-partitioned by their leading bytes between sampled splitters and sorted in their partition; records with the same lead meet in one
partition, so neighbours are never apart. There, for every offset of the anchor in a string, the strings are sorted and
compared with their neighbours. A lead with more than `HOT_LEAD` records isn't gathered: its strings are spread by their
own hash instead.

Equal texts are told by their digest first and only one of them goes on.

Defined cases: a null text is an empty one; a text shorter than LENGTH is never touched; equal texts of at least LENGTH bytes are
removed whole, all of them; rows with equal or null doc_id are rows of their own; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import slices, table
from shelfwatch.llm.fingerprints import BASE, mix
from shelfwatch.session import cut_lineage, scratch_path

LENGTH, LEAD = 200, 32
LEFT = LENGTH - LEAD
HOT_LEAD = 50_000
SLICE_BYTES = 2_000_000
PLACE_BITS = 24
RECORD = "lead binary, uid long, places array<int>, left_bytes int, right_bytes int, around binary"
SPAN = "uid long, first long, last long"


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the LEAD bytes from each place on, by doubling."""
    h, length, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
    while length < LEAD:
        h = h[:-length] * power + h[length:]
        length, power = length * 2, power * power
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, lead hash) of all anchors of texts of at least LENGTH bytes each."""
    numbers, places, leads = [], [], []
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:  # a very long text in stretches that overlap
        text, step = texts[0], SLICE_BYTES - LENGTH + 1
        for start in range(0, len(text) - LENGTH + 1, step):
            _, place, lead = anchors([text[start : start + SLICE_BYTES]])
            places.append(place + start)
            leads.append(lead)
        place, lead = np.concatenate(places), np.concatenate(leads)
        _, first = np.unique(place, return_index=True)
        return np.zeros(len(first), np.int64), place[first], lead[first]
    ends = np.cumsum([len(t) for t in texts])
    with np.errstate(over="ignore"):
        h = lead_hashes(np.frombuffer(b"".join(texts), np.uint8))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - LEAD + 1)
    for begin, end in zip(ends - [len(t) for t in texts], ends):
        numbers.append(np.unique(least[begin : end - LENGTH + 1] & low).astype(np.int64))
    counts = [len(n) for n in numbers]
    place = np.concatenate(numbers)
    owner = np.repeat(np.arange(len(texts)), counts)
    return owner, place - (ends - [len(t) for t in texts])[owner], h[place]


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def rolling_hashes(around: np.ndarray):
    """(offset, two hashes per record) of the LENGTH bytes that start `offset` before the anchor, for offsets 0 to LEFT.

    Each hash follows from the one before, so that memory is a few numbers per record.
    """
    columns = np.ascontiguousarray(around.T)
    one = np.uint64(1)
    with np.errstate(over="ignore"):
        hashes = []
        for base in map(np.uint64, BASES):
            h = np.zeros(columns.shape[1], np.uint64)
            for column in columns[LEFT + LENGTH - 1 : LEFT - 1 : -1]:
                h = h * base + column.astype(np.uint64) + one
            hashes.append((h, base, np.uint64(pow(int(base), LENGTH - 1, 1 << 64))))
        for offset in range(LEFT + 1):
            if offset:
                new, old = (columns[LEFT - offset + x].astype(np.uint64) + one for x in (0, LENGTH))
                hashes = [(new + base * (h - old * top), base, top) for h, base, top in hashes]
            yield offset, mix(hashes[0][0]), mix(hashes[1][0])


def block_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around anchors as a matrix with the anchor in column LEFT, and how many bytes are there on either side."""
    left, right = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
    around = np.frombuffer(b"".join(b"\0" * (LEFT - r[3]) + r[5] + b"\0" * (LENGTH - r[4]) for r in rows), np.uint8)
    return around.reshape(len(rows), LEFT + LENGTH), left, right


def repeated_offsets(rows: list[tuple]) -> np.ndarray:
    """For every record and offset: whether its string is that of another record, or of a second place of its own."""
    around, left, right = block_of(rows)
    several = np.array([len(r[2]) > 1 for r in rows])
    found = np.zeros((len(rows), LEFT + 1), bool)
    for k, first, second in rolling_hashes(around):
        there = (k <= left) & (LENGTH - k <= right)
        found[:, k] = there & several
        some = np.flatnonzero(there)
        if len(some) > 1:
            order = some[np.argsort(first[some], kind="stable")]
            same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
            found[order[1:][same], k] = True
            found[order[:-1][same], k] = True
    return found


def spans_of(rows: list[tuple], found: np.ndarray) -> pa.RecordBatch:
    """Covered stretches: the strings of one anchor all contain its lead, so each anchor covers one stretch."""
    hit = np.flatnonzero(found.any(axis=1))
    nearest, farthest = found.argmax(axis=1), LEFT - found[:, ::-1].argmax(axis=1)
    uid, first, last = [], [], []
    for i in hit.tolist():
        for place in rows[i][2]:
            uid.append(rows[i][1])
            first.append(place - int(farthest[i]))
            last.append(place - int(nearest[i]) + LENGTH)
    return pa.RecordBatch.from_pydict({"uid": pa.array(uid, pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})


def compare_sorted(records: DataFrame, block: int = 4096) -> DataFrame:
    """Spans of the strings that occur again, from records sorted by lead in partitions that share no lead."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                held += zip(*(c.to_pylist() for c in batch.slice(start, 2048).columns))
                if len(held) >= block:
                    cut = len(held)
                    while cut and held[cut - 1][0] == held[-1][0]:  # the last lead may go on
                        cut -= 1
                    if cut:
                        yield spans_of(held[:cut], repeated_offsets(held[:cut]))
                        held = held[cut:]
        if held:
            yield spans_of(held, repeated_offsets(held))

    return records.mapInArrow(run, SPAN)


def compare_spread(records: DataFrame, parts: int) -> DataFrame:
    """The same for records of hot leads: a row per string, brought together by the string's own hash."""

    def expand(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)))
                around, left, right = block_of(rows)
                uids = np.array([r[1] for r in rows], np.int64)
                for k, first, second in rolling_hashes(around):
                    row = np.flatnonzero((k <= left) & (LENGTH - k <= right))
                    pick = np.repeat(row, [len(rows[i][2]) for i in row.tolist()])
                    begin = np.array([p - k for i in row.tolist() for p in rows[i][2]], np.int64)
                    made = [first[pick].view(np.int64), second[pick].view(np.int64), np.full(len(pick), k, np.int32), uids[pick], begin]
                    yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=["h", "g", "k", "uid", "first"])

    # a string may hold two anchors; only its occurrences around the same one are counted
    strings = records.mapInArrow(expand, "h long, g long, k int, uid long, first long")
    several = strings.groupBy("h", "g", "k").agg(F.count("*").alias("n")).where("n > 1").select("h", "g", "k")
    return strings.join(several, ["h", "g", "k"], "left_semi").select("uid", "first", (F.col("first") + LENGTH).alias("last"))


def shared_leads(rows: DataFrame) -> DataFrame:
    """The rows of (lead, uid, several) whose lead is in another row too or several times in its own text.

    `rows` is sorted by lead in partitions.
    """

    def run(batches):
        last, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = batch.column(0).to_numpy()
            same = np.r_[False, lead[1:] == lead[:-1]]
            shared = same | np.r_[same[1:], False] | batch.column(2).to_numpy(zero_copy_only=False)
            if last is not None and lead[0] == last:
                shared[0] = True
                if waiting is not None:
                    yield waiting
            last, waiting = lead[-1], None if shared[-1] else batch.slice(batch.num_rows - 1)
            yield batch.filter(pa.array(shared))

    return rows.mapInArrow(run, rows.schema)


def bucketed_texts(docs: DataFrame, parts: int) -> DataFrame:
    """(uid, n_bytes, digest, the columns of `docs`) written once in buckets of uid, so that no later join moves the texts."""
    spark = docs.sparkSession
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("uid", F.monotonically_increasing_id())
    keyed = keyed.withColumns({"n_bytes": F.octet_length("text").cast("long"), "digest": F.sha2("text", 256)})
    name = f"texts_{uuid.uuid4().hex}"
    writer = keyed.coalesce(spark.sparkContext.defaultParallelism).write.bucketBy(parts, "uid")
    writer.option("path", scratch_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_spans(texts: DataFrame, parts: int, hot_lead: int = HOT_LEAD) -> DataFrame:
    """(uid, first, last): stretches of bytes that cover all strings of LENGTH bytes occurring again; `texts` are all different."""

    def tell_leads(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                for first, some in slices([t.encode() for t in part.column(1).to_pylist()], SLICE_BYTES):
                    owner, _, lead = anchors(some)
                    order = np.lexsort((lead, owner))
                    owner, lead = owner[order], lead[order]
                    new = np.r_[True, (owner[1:] != owner[:-1]) | (lead[1:] != lead[:-1])]
                    again = np.diff(np.r_[np.flatnonzero(new), len(lead)]) > 1
                    uid = part.column(0).to_numpy()[first + owner[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(lead[new].view(np.int64)), pa.array(uid), pa.array(again)], names=["lead", "uid", "several"])

    long_texts = texts.where(F.col("n_bytes") >= LENGTH).select("uid", "text")
    leads = long_texts.mapInArrow(tell_leads, "lead long, uid long, several boolean")
    shared = cut_lineage(shared_leads(leads.repartition(parts, "lead").sortWithinPartitions("lead")))
    hot = shared.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > hot_lead).select("lead", F.lit(True).alias("hot"))
    marked = shared.join(hot, "lead", "left").select("uid", F.struct("lead", F.coalesce("hot", F.lit(False)).alias("hot")).alias("lead"))
    wanted = marked.groupBy("uid").agg(F.collect_list("lead").alias("leads"))  # a text's own anchors
    chosen = long_texts.join(wanted.hint("shuffle_hash"), "uid").select("uid", "text", F.col("leads.lead").alias("leads"), F.col("leads.hot").alias("hot"))

    def tell_records(batches):
        made: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                uids, texts_, leads_, hots = (c.to_pylist() for c in part.columns)
                for first, some in slices([t.encode() for t in texts_], SLICE_BYTES):
                    owner, place, lead = anchors(some)
                    cuts = np.searchsorted(owner, np.arange(len(some) + 1))
                    for i, text in enumerate(some):
                        hot_of = dict(zip(leads_[first + i], hots[first + i]))
                        groups: dict = {}
                        for p, h in zip(place[cuts[i] : cuts[i + 1]].tolist(), lead[cuts[i] : cuts[i + 1]].view(np.int64).tolist()):
                            if h in hot_of:
                                a = max(0, p - LEFT)
                                groups.setdefault((text[a : p + LENGTH], p - a, h), []).append(p)
                        for (around, left, h), places in groups.items():
                            made.append((around[left : left + LEAD], uids[first + i], places, left, len(around) - left, around, hot_of[h]))
                        if len(made) >= 4096:
                            yield pack(made)
                            made = []
        if made:
            yield pack(made)

    kinds = [pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in RECORD.split(", ")] + ["hot"]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    records = chosen.mapInArrow(tell_records, RECORD + ", hot boolean")
    cold = records.where("not hot").drop("hot").repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    spans = compare_sorted(cold)
    if not hot.isEmpty():
        spans = spans.unionByName(compare_spread(records.where("hot").drop("hot"), parts))
    return spans


def cover(n_bytes: int, spans: list) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    runs: list[list[int]] = []
    for first, last in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, min(b, n_bytes)) for a, b in runs]


def find_repeats(docs: DataFrame, hot_lead: int = HOT_LEAD) -> DataFrame:
    """`docs` with uid, n_bytes and spans: array of (first, last) stretches of bytes of strings that start again elsewhere."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = bucketed_texts(docs, parts)
    classes = texts.groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("n"))
    one_each = texts.join(classes.select("uid").hint("shuffle_hash"), "uid")
    spans = repeated_spans(one_each, parts, hot_lead)
    by_text = spans.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # bounded by a text's length
    copies = texts.select("uid", "digest", "n_bytes").join(classes.where("n > 1").select("digest", F.lit(True).alias("copied")), "digest")
    copies = copies.where(F.col("n_bytes") >= LENGTH).select("uid", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last"))).alias("whole"))
    told = cut_lineage(by_text.join(copies, "uid", "full_outer").select("uid", F.coalesce("whole", "spans").alias("spans")))
    return texts.join(told.hint("shuffle_hash"), "uid", "left").drop("digest")


REMOVED_FIELDS = "n_removed long, n_spans long, kept_sha256 string"


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the characters that they have only a part of."""
    inside = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            inside.append((a, b))
    return inside


def without_repeats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` and text, without the repeated stretches' whole characters; texts that have only blanks left are left out."""
    found = find_repeats(docs.select(*columns, "text"))

    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n = part.num_columns
                made, keep = [], []
                for text, size, spans in zip(*(part.column(i).to_pylist() for i in (n - 3, n - 2, n - 1))):
                    if spans:
                        data = text.encode()
                        edges = [0, *(x for r in whole_characters(data, cover(size, [(s["first"], s["last"]) for s in spans])) for x in r), size]
                        text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                    made.append(text)
                    keep.append(not spans or bool(text.strip()))
                table_ = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n - 3)), pa.array(made, pa.string())], names=[*columns, "text"])
                yield table_.filter(pa.array(keep, pa.bool_()))

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return found.select(*columns, "text", "n_bytes", "spans").mapInArrow(cut, f"{kept_types}, text string")


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = find_repeats(table(spark, folder, "documents").select("doc_id", "text"))

    def digest(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for text, n, spans in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    data, runs = text.encode(), cover(n, [(s["first"], s["last"]) for s in spans or []])
                    edges = [0, *(x for r in runs for x in r), n]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc_id", "text", "n_bytes", "spans").mapInArrow(digest, f"doc_id long, n_bytes long, {REMOVED_FIELDS}")
