"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has the minima of its shingle hashes under `POSITIONS` permutations, 16 bits of each of the first `INDEXED` and 8
of the others. The indexed ones are split into `CHUNKS` chunks, and each chunk is put under one key per position that may be in
error, without that position. By the pigeonhole principle two signatures that differ in fewer than 2 * CHUNKS indexed positions
agree but for one position in some chunk, so they share a key: no such pair is lost, others with a small chance (README). A pair is told in the first bucket it
shares, if its whole signatures are no further apart than those of linked sets and the bound of its maps allows it, and
confirmed on the full sets. A map has a bit for every remainder of a hash that the set has; a bit of one set only stands for
a shingle of it only, so the maps bound the intersection from above.

Documents with equal sets are one node. A bucket may hold a large group of copies, so pairs are told in two rounds. The first
confirms a minimum spanning tree of signature distances for some of the keys, which finds nearly all components with few pairs. The
second tells every pair of a bucket that is in two components still. No bucket, pair or candidate is dropped: a bucket of more rows than
a block is dealt to cells, each grows a tree of its own, and in the second round each two cells that are not of one component
are a group of their own.

Defined cases: null, blank and empty texts have empty sets, which are linked with nothing; so is a row with a null doc_id, whose
component is null and which is kept; rows with equal doc_id are rows of their own, linked through their texts, but sets with the same
smallest doc_id share their links; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import slices, table
from shelfwatch.llm.fingerprints import mix
from shelfwatch.session import cut_lineage

POSITIONS, INDEXED, CHUNKS = 192, 60, 10
PER_CHUNK = INDEXED // CHUNKS
MINIMA_BYTES = 2 * INDEXED + POSITIONS - INDEXED
MAP_BYTES = 256
SIGNATURE_BYTES = MINIMA_BYTES + MAP_BYTES
#: Buckets are compared in blocks of so many signatures, and spanning trees are grown inside a block.
BLOCK = 1024
#: A bucket of more rows is told in pairs of cells.
CELL = 4 * BLOCK
SLICE_BYTES = 1_500_000
BLANK_BYTE = np.zeros(256, bool)
BLANK_BYTE[[0x20, *range(0x09, 0x0E)]] = True


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTE_VALUES = spread(256, 1)
PERMUTE, SHIFT = (spread(POSITIONS, s).astype(np.uint32) | np.uint32(1) for s in (2, 3))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every blank-separated word of a byte array.

    A word's hash is the sum of a number per byte times a number per place in the word, so no two words share one by structure.
    """
    solid = ~BLANK_BYTE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, np.uint64)
    length = end - start
    with np.errstate(over="ignore"):
        places = np.arange(len(data)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)]))
        weights = spread(int(length.max()) + 1, 4)
        value = BYTE_VALUES[data] * weights[np.minimum(places, len(weights) - 1)]
        value[~solid] = 0
        return start, mix(np.add.reduceat(value, start) + length.astype(np.uint64))


def all_word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """`word_hashes` of a long text, piece by piece; pieces end at a space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            end = data.rfind(b" ", at, end) + 1 or data.find(b" ", end) + 1 or len(data)
        start, word = word_hashes(np.frombuffer(data[at:end], np.uint8))
        starts.append(start + at)
        hashes.append(word)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, text after text, and how many each text has; a shorter text with words is one shingle."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, word = all_word_hashes(b" ".join(texts) + b" ")
    first = np.searchsorted(start, np.r_[0, ends])
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    total = np.cumsum(shingles)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(first[:-1] - (total - shingles), shingles)
    limit = np.repeat(first[1:], shingles)
    with np.errstate(over="ignore"):
        made = np.zeros(len(at), np.uint64)
        for k in range(size - 1, -1, -1):
            inside = at + k < limit
            part = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else made
            made = np.where(inside, mix(made * np.uint64(3) + part + np.uint64(k)), made)
    return made, shingles


def signatures(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The signature of each run of hashes: indexed minima, other minima, map; zeros for an empty run."""
    minima, maps = np.zeros((len(counts), POSITIONS), np.uint16), np.zeros((len(counts), 8 * MAP_BYTES), bool)
    filled = counts > 0
    if filled.any():
        starts = (np.cumsum(counts) - counts)[filled]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(POSITIONS):
            least = np.minimum.reduceat((low ^ SHIFT[k]) * PERMUTE[k], starts)
            minima[filled, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
        maps[np.repeat(np.arange(len(counts)), counts), (hashes % np.uint64(8 * MAP_BYTES)).astype(np.int64)] = True
    wide, narrow = minima[:, :INDEXED].astype(">u2"), minima[:, INDEXED:].astype(np.uint8)
    return [w.tobytes() + n.tobytes() + m.tobytes() for w, n, m in zip(wide, narrow, np.packbits(maps, axis=1))]


def pack_set(hashes: np.ndarray) -> bytes:
    """A set as its distinct hashes in order, 40 bits of each."""
    values = np.unique(hashes >> np.uint64(24))
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    padded = np.zeros((len(data) // 5, 8), np.uint8)
    padded[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return padded.view(">u8").ravel().astype(np.uint64)


def over_sets(docs: DataFrame, size: int, schema: str, build) -> DataFrame:
    """(doc_id and what `build(hashes of a slice, counts)` gives as columns) for (doc_id, text)."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [(t or "").encode().lower() for t in part.column(1).to_pylist()]
                for first, some in slices(texts, SLICE_BYTES):
                    hashes, counts = shingle_sets(some, size)
                    ends = np.cumsum(counts)
                    sets = [hashes[a:b] for a, b in zip(ends - counts, ends)]
                    made = build(hashes, counts, sets)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(some)), *(pa.array(c, k) for c, k in zip(made, kinds))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, signature): documents with equal sets have equal keys."""

    def build(hashes, counts, sets):
        distinct = [np.unique(s) for s in sets]
        with np.errstate(over="ignore"):
            keys = [[int((mix(d ^ np.uint64(salt)).sum() + np.uint64(len(d))).astype(np.int64)) for d in distinct] for salt in (5, 6)]
        return [len(d) for d in distinct], *keys, signatures(hashes, counts)

    return over_sets(docs, size, "n_shingles long, key_a long, key_b long, signature binary", build)


def index_keys(signature) -> Column:
    """An array with one key per chunk and position in error."""
    keys = []
    for chunk in range(CHUNKS):
        begin = 2 * PER_CHUNK * chunk + 1
        for skipped in range(PER_CHUNK):
            before = F.substring(signature, begin, 2 * skipped)
            after = F.substring(signature, begin + 2 * skipped + 2, 2 * (PER_CHUNK - skipped - 1))
            keys.append(F.xxhash64(F.lit(chunk * PER_CHUNK + skipped), before, after))
    return F.array(*keys)


def runs(batches, trees: bool):
    """Consecutive rows with equal `key`, as tables; runs that can give no pair are left out where a batch shows it."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        useless = np.diff(np.r_[start, len(key)]) < 2 if trees else np.minimum.reduceat(part, start) == np.maximum.reduceat(part, start)
        useless[[0, -1]] = False  # these may go on in other batches
        end = np.r_[start[1:], len(key)]
        for a, b in zip(start[~useless].tolist(), end[~useless].tolist()):
            if held and held[-1].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def hot_keys(rows: DataFrame, limit: int) -> DataFrame:
    """(key, n) of the keys that more than `limit` rows of (key, id, place) have."""
    return cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit))


def dealt_rows(rows: DataFrame, block: int) -> DataFrame:
    """(key, id, place, side) of `rows`, larger buckets as several of about `block` rows, each under a key of its own."""
    hot = hot_keys(rows, block)
    cell = F.pmod(F.xxhash64("key", "id"), F.ceil(F.col("n") / F.lit(block)))
    dealt = rows.join(hot, "key", "left").withColumn("key", F.when(F.col("n").isNotNull(), F.xxhash64("key", cell)).otherwise(F.col("key")))
    return dealt.select("key", "id", "place", F.lit(False).alias("side"))


def paired_rows(rows: DataFrame, labels: DataFrame, cell: int) -> DataFrame:
    """(key, id, place, side) of `rows`, a larger bucket as one for each two of its cells, of about `cell` rows each, with `side` for the second.

    A component that fills cells has them for itself; two such cells of one component are not paired. The others share mixed cells, which
    are paired with all and themselves. A bucket of one component is left out.
    """
    hot = hot_keys(rows, cell)
    cold = rows.join(hot.select("key"), "key", "left_anti").select("key", "id", "place", F.lit(False).alias("side"))
    if hot.isEmpty():
        return cold
    labelled = cut_lineage(rows.join(hot.select("key"), "key").join(labels, "id", "left").select("key", "id", "place", F.coalesce("component", "id").alias("component")))
    parts = cut_lineage(labelled.groupBy("key", "component").agg(F.count("*").alias("m")))
    large = F.col("m") >= cell
    mixed = F.ceil(F.sum(F.when(large, 0).otherwise(F.col("m"))) / F.lit(cell)).cast("long").alias("mixed")
    owned = F.ceil(F.col("m") / F.lit(cell)).cast("long")
    layout = parts.groupBy("key").agg(mixed, F.sum(F.when(large, owned).otherwise(0)).alias("more"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    before = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    owners = parts.where(large).select("key", "component", owned.alias("cells"), F.coalesce(F.sum(owned).over(before), F.lit(0)).alias("ahead"))
    placed = labelled.join(layout, "key").join(owners, ["key", "component"], "left")
    first = F.col("mixed") + F.col("ahead")
    placed = placed.withColumn("cell", F.when(F.col("cells").isNotNull(), first + F.pmod(F.xxhash64("id"), F.col("cells"))).otherwise(F.pmod(F.xxhash64("id"), F.col("mixed"))))
    every = F.sequence(F.lit(0).cast("long"), F.col("mixed") + F.col("more") - 1)
    others = F.filter(every, lambda y: F.col("cells").isNull() | (y < first) | (y >= first + F.col("cells")))
    placed = placed.select("key", "id", "place", "cell", F.explode(others).alias("other"))
    pair = F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other"))
    return cold.unionByName(placed.select(pair.alias("key"), "id", "place", (F.col("cell") > F.col("other")).alias("side")))


def shared_keys(indexed: DataFrame) -> DataFrame:
    """The rows of (key, id, place) whose key more than one row has; `indexed` is sorted by key inside partitions."""

    def run(batches):
        last, waiting = None, None  # the last row so far, if it may still be alone
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = np.r_[False, key[1:] == key[:-1]]
            shared = same | np.r_[same[1:], False]
            if last is not None and key[0] == last:
                shared[0] = True
                if waiting is not None:
                    yield waiting
            alone_so_far = not shared[-1]
            last, waiting = key[-1], batch.slice(batch.num_rows - 1) if alone_so_far else None
            yield batch.filter(pa.array(shared))

    return indexed.mapInArrow(run, indexed.schema)


def distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Positions in which the minima of signatures differ; rows of bytes against rows of bytes."""
    differ = one[..., :MINIMA_BYTES] != others[..., :MINIMA_BYTES]
    wide = differ[..., : 2 * INDEXED : 2] | differ[..., 1 : 2 * INDEXED : 2]
    return wide.sum(axis=-1, dtype=np.int32) + differ[..., 2 * INDEXED :].sum(axis=-1, dtype=np.int32)


def first_places(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first place, chunk and position in error, whose key the signatures share."""
    differ = one[: 2 * INDEXED] != others[:, : 2 * INDEXED]
    wrong = (differ[:, ::2] | differ[:, 1::2]).reshape(len(others), CHUNKS, PER_CHUNK)
    chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * PER_CHUNK + wrong[np.arange(len(others)), chunk].argmax(axis=1)


def most_shared(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """An upper bound of the intersection of a set with others, from the maps."""
    a, b = one[MINIMA_BYTES:].view(np.uint64), np.ascontiguousarray(others[:, MINIMA_BYTES:]).view(np.uint64)
    only_a, only_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a & ~b, b & ~a))
    return np.minimum(size - only_a, sizes - only_b)


def spanning_tree(rows: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest whose edges are not longer than `most`."""
    n = len(rows)
    near, via, out = np.full(n, most + 1), np.zeros(n, np.int64), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        out[at] = False
        left = np.flatnonzero(out)
        d = distances(rows[at], rows[left])
        closer = d < near[left]
        near[left[closer]], via[left[closer]] = d[closer], at
        nearest = left[np.argmin(near[left])]
        if near[nearest] <= most:
            edges.append((int(via[nearest]), int(nearest)))
        at = nearest
    return edges


def bucket_pairs(rows: DataFrame, most: int, percent: int, trees: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of (key, id, component, place, size, signature, side) rows, sorted by key inside partitions.

    With `trees` the edges of the buckets' spanning trees; else all pairs of two components, and two sides where a bucket has them, that may be linked.
    """

    def run(batches):
        found: list[np.ndarray] = []
        held = 0
        for bucket in runs(batches, trees):
            if bucket.num_rows < 2:
                continue
            ids, part, size = (bucket.column(c).to_numpy() for c in ("id", "component", "size"))
            if not trees and (part == part[0]).all():
                continue
            code = np.frombuffer(b"".join(bucket.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE_BYTES)
            if trees:
                for start in range(0, len(ids), BLOCK):
                    made = spanning_tree(code[start : start + BLOCK], most)
                    if made:
                        found.append(np.sort(ids[start + np.array(made)], axis=1))
                        held += len(made)
            else:
                place = bucket.column("place")[0].as_py()
                side = bucket.column("side").to_numpy()
                order = np.lexsort((part, side))
                ids, part, size, code = ids[order], part[order], size[order], code[order]
                across = np.count_nonzero(~side) if side.any() else 0  # where the second side begins
                for i in range(across or (0 if side.any() else len(ids) - 1)):
                    if across:
                        rest = across + np.flatnonzero(part[across:] != part[i])
                    else:
                        rest = np.arange(np.searchsorted(part, part[i], side="right"), len(ids))
                    hit = rest[distances(code[i], code[rest]) <= most]
                    if len(hit):
                        both = most_shared(code[i], code[hit], size[i], size[hit])
                        hit = hit[100 * both >= percent * (size[i] + size[hit] - both)]
                    if len(hit):
                        hit = hit[first_places(code[i], code[hit]) == place]
                    if len(hit):
                        found.append(np.sort(np.stack([np.full(len(hit), ids[i]), ids[hit]], axis=1), axis=1))
                        held += len(hit)
            if held >= 50_000:
                yield pack(found)
                found, held = [], 0
        if found:
            yield pack(found)

    def pack(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are linked: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                keep, before, last = [], None, None
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if x != before:
                        before, last = x, unpack_set(x)
                    other = unpack_set(y)
                    both = len(np.intersect1d(last, other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(last) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # sets whose sizes alone rule a link out are not compared
    first = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")
    smaller, larger = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    return joined.where(100 * smaller >= percent * larger).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in `links` (a, b): the smallest id that can be reached.

    Every id takes the smallest label among its neighbours, then the label of its label, until nothing changes. Each step is a
    written table, so that plans stay short and a lost executor costs one step.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")))
    while True:
        told = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("told"))
        moved = labels.join(told, "id").select("id", F.col("component").alias("old"), F.least("component", "told").alias("component"))
        ahead = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = cut_lineage(moved.join(ahead, "component").select("id", "old", F.least("component", "next").alias("component")))
        labels = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; sets of `size`-word shingles linked at `percent` likeness."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    share = 1 - percent / 100
    most = min(POSITIONS, math.ceil(POSITIONS * share + 4.5 * math.sqrt(POSITIONS * share * (1 - share))))
    plain = docs.select("doc_id", "text")
    described = cut_lineage(describe(plain, size))
    usable = described.where("n_shingles > 0 and doc_id is not null")
    nodes = usable.groupBy("key_a", "key_b", "n_shingles").agg(F.min(F.struct(F.col("doc_id").alias("id"), "signature")).alias("node"))
    nodes = cut_lineage(nodes.select("key_a", "key_b", "n_shingles", "node.id", "node.signature"))
    indexed = nodes.select("id", F.posexplode(index_keys(F.col("signature"))).alias("place", "key"))
    indexed = indexed.select("key", "id", "place").repartition(parts, "key").sortWithinPartitions("key")
    shared = cut_lineage(shared_keys(indexed))
    involved = shared.select("id").distinct()
    chosen = plain.where(F.col("doc_id").isNotNull()).join(involved, F.col("doc_id") == F.col("id"), "left_semi")
    sets = over_sets(chosen, size, "members binary", lambda hashes, counts, sets: [[pack_set(s) for s in sets]])
    sets = cut_lineage(sets.select(F.col("doc_id").alias("id"), "members"))
    signed = nodes.select("id", F.col("n_shingles").alias("size"), "signature")

    def bucketed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        full = rows.join(signed, "id")
        full = full.withColumn("component", F.col("id")) if labels is None else full.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        return full.select("key", "id", "component", "place", "size", "signature", "side").repartition(parts, "key").sortWithinPartitions("key")

    exact = shared.where(F.col("place") % PER_CHUNK == 0)  # one key of each chunk
    first = cut_lineage(confirm(bucket_pairs(bucketed(dealt_rows(exact, BLOCK), None), most, percent, True), sets, percent))
    labels = components(first)
    second = cut_lineage(confirm(bucket_pairs(bucketed(paired_rows(shared, labels, CELL), labels), most, percent, False), sets, percent))
    linked = components(first.unionByName(second))
    named = nodes.join(linked, "id", "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    named = named.groupBy("key_a", "key_b", "n_shingles").agg(F.min("component_id").alias("component_id"))
    joined = described.drop("signature").join(named, ["key_a", "key_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
