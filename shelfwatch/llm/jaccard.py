"""Exact Jaccard join of shingle sets with adaptive multi-match prefixes.

All sets are put into one order of tokens, rare ones first. Of two linked sets x and y, which share `a` tokens at least, the first |x| - a + l
and |y| - a + l tokens have l or more in common: what lies behind a prefix has room for a - l only. A document chooses l for itself. A longer
prefix is looked up more often, but more of its tokens must be shared before a pair is compared, so each document takes the l whose
estimated cost, from the document counts of its own prefix tokens, is least; a pair needs the smaller l of its two. `a` is taken from both sizes. A
document with fewer shared tokens in a prefix than that prefix must share is linked with nothing and is left out. Candidate pairs are compared on their full sets,
64 bits a token.

The order comes from counts of all shingles in `CELLS` cells, in powers of two above the usual cell, so its size is fixed; tokens of one class are in order
of their hashes. Any order gives the same links; this one keeps very frequent tokens out of the prefixes of documents that have others.

Documents with equal sets are one node. Links are found in two rounds, so that a group of near copies does not give all its pairs: the first compares the
edges of spanning trees, grown over small bitmaps of the sets in the buckets of each node's rarest shared tokens; then all pairs of nodes that are in two
components still are told, and what their prefixes share is counted. A pair whose bitmaps differ too much for a link is not told; a map grows with its set,
so that those of long texts do not fill up and tell texts apart that share a few phrases only. A pair shares tens or hundreds of tokens of its prefixes; it is told at
the most frequent one, which a bucket knows from the most frequent tokens of its nodes, so that a pair is a row and not a row per token. A token's nodes beyond a few thousand are
dealt to pairs of cells. No other pair, bucket or candidate is dropped.

Defined cases: null, blank and empty texts have empty sets, which are linked with nothing; so is a row with a null doc_id, whose component is null. Rows with
equal doc_id are rows of their own, linked through their texts; repeated rows have equal sets. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import slices, table
from shelfwatch.llm.neardup import BLOCK, CELL, SLICE_BYTES, components, dealt_rows, over_sets, paired_rows, runs, shingle_sets
from shelfwatch.llm.fingerprints import mix
from shelfwatch.session import cut_lineage

#: Cells of the counts behind the token order, and how many of them travel as one row.
CELLS, CELL_ROW = 1 << 20, 1 << 10
#: A document's tokens are looked up as far as a prefix of so many matches, and a share of its size, needs. More or fewer change no result.
MATCHES, MATCH_SHARE = 16, 10
#: Comparing a pair costs as much as this share of the set's size in counted tokens.
COMPARE_SHARE = 0.25
#: Document counts are told up to here; they only feed the estimate.
COUNTED = 1 << 16
#: Spanning trees are grown in the buckets of so many shared tokens of a document, its rarest.
TREE_TOKENS = 8
#: Every row of a bucket has the most frequent tokens of its document's prefix, so many; a pair that shares one of them above the bucket's is told there.
#: Rare ones would not do: they are what near copies do not share.
FIRST = 4
#: A token and its place in the prefix.
FIRST_ROW = np.dtype([("key", np.int64), ("pos", np.int32)])
#: So many pairs of a bucket's rows are looked at at once, and so many bytes of their maps.
LOOKED_AT, LOOKED_AT_BYTES = 1 << 17, 1 << 24
#: The least number of bits of the map of a set; maps bound what two sets share. A map has the first bits of an eighth more than tokens, at least, and a fourth of them, at least.
MAP_BITS = 1024
#: The largest sets of the levels of maps; the next level has twice as many bits.
MAP_SIZES = (MAP_BITS * 7 // 8) << np.arange(14)


# --- the order of tokens -----------------------------------------------------------------------------------

def token_heat(docs: DataFrame, size: int) -> np.ndarray:
    """The class of every cell: how many powers of two its count is above the median cell, of all shingles of all texts."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                texts = [(t or "").encode().lower() for t in batch.slice(start, 2000).column(0).to_pylist()]
                for _, some in slices(texts, SLICE_BYTES):
                    total += np.bincount((shingle_sets(some, size)[0] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            rows = total.reshape(-1, CELL_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["row", "counts"])

    def classify(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[row] = sums.get(row, 0) + np.frombuffer(counts, np.int64)
        for row, counts in sums.items():
            kind = np.log2(np.maximum(counts / (np.median(counts) + 1), 1)).astype(np.int16)
            hot = np.flatnonzero(kind)
            yield pa.RecordBatch.from_arrays([pa.array(hot + row * CELL_ROW, pa.int32()), pa.array(kind[hot], pa.int16())], names=["cell", "kind"])

    counted = docs.select("text").mapInArrow(count, "row int, counts binary").repartition(parts, "row")
    hot = counted.mapInArrow(classify, "cell int, kind short").toArrow()  # hot cells only, CELLS at most
    heat = np.zeros(CELLS, np.uint8)
    heat[hot.column("cell").to_numpy()] = hot.column("kind").to_numpy()
    return heat


def least_shared(size, percent: int):
    """The least number of tokens that a set of this size shares with any linked one."""
    return -(-percent * size // 100)


def most_matches(size: int) -> int:
    return MATCHES + size // MATCH_SHARE


# --- maps of sets ------------------------------------------------------------------------------------------

def map_level(size):
    return np.searchsorted(MAP_SIZES, size)


def set_map(distinct: np.ndarray) -> bytes:
    """Which of the first ranges of hashes the set has tokens in: of `MAP_BITS` ranges all, of twice as many half, of more a fourth."""
    level = int(map_level(len(distinct)))
    bits = np.zeros(MAP_BITS << max(level - 2, 0), bool)
    at = ((distinct >> np.uint64(32)) & np.uint64((1 << 24) - 1)).astype(np.int64) // ((1 << 24) // (MAP_BITS << level))
    bits[at[at < len(bits)]] = True
    return np.packbits(bits).tobytes()


def stacked(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def halved(maps: np.ndarray) -> np.ndarray:
    """Maps of a level as those of the level below, as far as they reach."""
    bits = np.unpackbits(maps.view(np.uint8), axis=1).reshape(len(maps), -1, 2).any(axis=2)
    return np.packbits(bits, axis=1).view(np.uint64)


def only_in(maps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The number of tokens, at least, that the sets of `maps` have and those of `other` have not."""
    return np.bitwise_count(maps & ~other).sum(axis=1, dtype=np.int64)


# --- nodes and prefixes ------------------------------------------------------------------------------------

def set_keys(distinct: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        return [int((mix(distinct ^ np.uint64(salt)).sum() + np.uint64(len(distinct))).astype(np.int64)) for salt in (7, 8)]


def describe(docs: DataFrame, size: int, percent: int, heat) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, prefix, map): equal sets have equal keys; the prefix is the longest that may be chosen."""

    def build(hashes, counts, sets):
        cells, made = heat.value, []
        for s in sets:
            distinct = np.unique(s)
            n = len(distinct)
            first = np.argsort(cells[(distinct & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")[: n - least_shared(n, percent) + most_matches(n)]
            made.append((n, *set_keys(distinct), distinct[first].tobytes(), set_map(distinct)))
        return list(zip(*made))

    return over_sets(docs, size, "n_shingles long, key_a long, key_b long, prefix binary, map binary", build)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, id, size, pos): every prefix token of every node."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                tokens = [np.frombuffer(p, np.int64) for p in part.column(2).to_pylist()]
                counts = np.array([len(t) for t in tokens])
                if counts.sum():
                    places = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
                    ids, sizes = (np.repeat(part.column(c).to_numpy(), counts) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(ids), pa.array(sizes), pa.array(places)], names=["key", "id", "size", "pos"])

    return nodes.select("id", "size", "prefix").mapInArrow(run, "key long, id long, size long, pos int")


def counted_postings(ordered: DataFrame) -> DataFrame:
    """The rows of `ordered`, sorted by key inside partitions, whose key others have, with the key's count (up to `COUNTED`)."""

    def with_count(batch, counts):
        return batch.append_column("df", pa.array(counts, pa.int32()))

    def run(batches):
        held, n, key = [], 0, None  # the rows of the key that may go on; none are held any more once it is very frequent

        def finished():
            if held and n > 1:
                yield from (with_count(b, np.full(b.num_rows, min(n, COUNTED))) for b in held)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            start = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            counts = np.diff(np.r_[start, len(keys)])
            if key is not None and keys[0] == key:
                first, rest = batch.slice(0, counts[0]), 1
                n += int(counts[0])
                held.append(first)
                if n > COUNTED:
                    yield from finished()
                    held = []
            else:
                yield from finished()
                held, rest = [], 0
                n = 0
            if rest < len(counts):
                if rest:
                    yield from finished()
                middle = slice(rest, len(counts) - 1)
                shared = np.repeat(np.minimum(counts[middle], COUNTED), counts[middle])
                part = batch.slice(int(start[rest]), len(shared))
                yield with_count(part, shared).filter(pa.array(shared > 1))
                held, n, key = [batch.slice(int(start[-1]))], int(counts[-1]), keys[-1]
        yield from finished()

    return ordered.mapInArrow(run, "key long, id long, size long, pos int, df int")


# --- the choice of prefixes --------------------------------------------------------------------------------

def chosen_matches(size: int, places: np.ndarray, counts: np.ndarray, percent: int) -> int:
    """The number of matches whose prefix costs least for a set, given places and document counts of its shared prefix tokens.

    0 if some prefix has fewer shared tokens than it would share with a linked set.
    """
    least = least_shared(size, percent)
    # no more than the smallest linked set is looked up for
    choices = np.arange(1, min(most_matches(least), least) + 1)
    inside = np.searchsorted(places, size - least + choices)  # shared tokens of each prefix
    if (inside < choices).any():
        return 0
    looked_up = np.r_[0, np.cumsum(counts - 1)][inside]
    cost = looked_up + looked_up / choices * (1 + COMPARE_SHARE * size)
    return int(choices[np.argmin(cost)])


def adapted(shared: DataFrame, percent: int) -> DataFrame:
    """(key, id, size, pos, matches, nth, rank, first): the prefix that each document chooses; nth is a token's place among its shared ones.

    rank is its place by falling document count; the row of nth 0 has the `FIRST` tokens of least rank.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                made = []
                for node, size, tokens in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns)):
                    tokens.sort(key=lambda t: t["pos"])
                    places, counts = (np.array([t[c] for t in tokens]) for c in ("pos", "df"))
                    matches = chosen_matches(size, places, counts, percent)
                    if matches:
                        end = size - least_shared(size, percent) + matches
                        chosen = [t for t in tokens if t["pos"] < end]
                        ranked = sorted(range(len(chosen)), key=lambda i: (-chosen[i]["df"], chosen[i]["key"]))
                        rank, first = np.argsort(ranked).tolist(), np.zeros(FIRST, FIRST_ROW)
                        first[: len(chosen)] = [(chosen[i]["key"], chosen[i]["pos"]) for i in ranked[:FIRST]]
                        made += [(t["key"], node, size, t["pos"], matches, i, rank[i], None if i else first.tobytes()) for i, t in enumerate(chosen)]
                if made:
                    names = ["key", "id", "size", "pos", "matches", "nth", "rank", "first"]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    # a group is the prefix of one document
    whole = shared.groupBy("id", "size").agg(F.collect_list(F.struct("key", "pos", "df")).alias("tokens"))
    return whole.mapInArrow(run, "key long, id long, size long, pos int, matches int, nth int, rank int, first binary")


# --- pairs -------------------------------------------------------------------------------------------------

def tree_edges(bucketed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the edges of a spanning tree of every bucket's maps, shortest first, that may be links.

    `bucketed` is (key, id, component, size, map), sorted by key inside partitions; a tree is grown over `BLOCK` rows at most, and over maps of one level
    and those of the next that may be linked with them.
    """

    def trees(ids, size, maps):
        level = map_level(size)
        for k in np.unique(level):
            here, above = np.flatnonzero(level == k), np.flatnonzero((level == k + 1) & (size * percent <= 100 * MAP_SIZES[min(k, len(MAP_SIZES) - 1)]))
            forms = stacked([maps[i] for i in here])
            if len(above):
                lower = halved(stacked([maps[i] for i in above]))
                words = min(forms.shape[1], lower.shape[1])
                forms, here = np.concatenate([forms[:, :words], lower[:, :words]]), np.r_[here, above]
            if len(here) > 1:
                yield tree(ids[here], size[here], forms)

    def tree(ids, size, maps):
        n = len(ids)
        near, via, out = np.full(n, 64 * maps.shape[1] + 1), np.zeros(n, np.int64), np.ones(n, bool)
        at, edges = 0, []
        for _ in range(n - 1):
            out[at] = False
            left = np.flatnonzero(out)
            apart = np.bitwise_count(maps[at] ^ maps[left]).sum(axis=1, dtype=np.int64)
            closer = apart < near[left]
            near[left[closer]], via[left[closer]] = apart[closer], at
            at = left[np.argmin(near[left])]
            edges.append((via[at], at))
        one, other = np.array(edges).T
        only_one, only_other = only_in(maps[one], maps[other]), only_in(maps[other], maps[one])
        may = np.minimum(size[one] - only_one, size[other] - only_other) >= -(-percent * (size[one] + size[other]) // (100 + percent))
        return np.sort(np.stack([ids[one[may]], ids[other[may]]], axis=1), axis=1)

    def run(batches):
        found, held = [], 0
        for bucket in runs(batches, True):
            if bucket.num_rows < 2:
                continue
            ids, size = (bucket.column(c).to_numpy() for c in ("id", "size"))
            maps = bucket.column("map").to_pylist()
            for start in range(0, len(ids) - 1, BLOCK):
                for edges in trees(*(x[start : start + BLOCK] for x in (ids, size, maps))):
                    found.append(edges)
                    held += len(edges)
            if held >= 50_000:
                yield pack(found)
                found, held = [], 0
        if held:
            yield pack(found)

    def pack(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return bucketed.mapInArrow(run, "a long, b long").distinct()


def whole_buckets(batches):
    """Tables of whole buckets, rows with equal `key`; buckets of one component are left out where a batch shows it."""
    held: list = []  # the bucket that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column("key").to_numpy(), batch.column("component").to_numpy()
        start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        if len(start) == 1 and held and held[0].column("key")[0].as_py() == key[0]:
            held.append(batch)
            continue
        useful = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start)
        useful[0] = True  # it may have begun before
        useful[-1] = False
        yield pa.Table.from_batches([*held, batch.filter(pa.array(np.repeat(useful, np.diff(np.r_[start, len(key)]))))])
        held = [batch.slice(int(start[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def counted_pairs(bucketed: DataFrame, percent: int) -> DataFrame:
    """(a, b, need) of two components that share a token of their prefixes, unless their maps rule a link out; need is what the prefixes must share.

    `bucketed` is (key, id, component, size, pos, matches, rank, side, map, first), sorted by key inside partitions. A shared token counts if it lies in the
    prefixes that the two sizes leave. A bit that only one map has stands for a token that only its set has. A pair is told at the token of least rank it shares, and again at
    others only if that is none of the `first` of both.
    """

    def by_level(maps, size):
        """Per level the place of every row in its level, its maps, and what of them and of the next level's can be compared."""
        level, place, forms, lower = map_level(size), np.zeros(len(size), np.int64), {}, {}
        for k in np.unique(level):
            rows = np.flatnonzero(level == k)
            place[rows], forms[k] = np.arange(len(rows)), stacked([maps[i] for i in rows])
        for k in forms:
            if k + 1 in forms:
                above = halved(forms[k + 1])
                words = min(forms[k].shape[1], above.shape[1])
                lower[k] = forms[k][:, :words], above[:, :words]
        return level, place, forms, lower

    def may_link(one, other, least, size, level, place, forms, lower):
        """Which pairs of rows, the first of each no larger than the other, may share as many tokens as `least` says."""
        only_one, only_other = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        for k in np.unique(level[one]):
            for above in (0, 1):
                pairs = np.flatnonzero((level[one] == k) & (level[other] == k + above))
                if len(pairs):
                    mine, theirs = lower[k] if above else (forms[k],) * 2
                    most = max(LOOKED_AT_BYTES // (8 * mine.shape[1]), 1)
                    for some in np.split(pairs, range(most, len(pairs), most)):
                        x, y = mine[place[one[some]]], theirs[place[other[some]]]
                        only_one[some], only_other[some] = only_in(x, y), only_in(y, x)
        return np.minimum(size[one] - only_one, size[other] - only_other) >= least

    def told_before(one, other, room, size, rank, first):
        """Which pairs of rows share one of the `first` tokens above the bucket's, in the prefixes that their sizes leave."""
        inside = [(np.arange(FIRST) < rank[x][:, None]) & (first["pos"][x] < (size[x] + room)[:, None]) for x in (one, other)]
        same = (first["key"][one][:, :, None] == first["key"][other][:, None, :]) & inside[0][:, :, None] & inside[1][:, None, :]
        return same.any(axis=(1, 2))

    def row_pairs(key, size):
        """Arrays of pairs of rows of one bucket, the first no larger than the other and both of sizes that may be linked."""
        bucket, row = np.cumsum(np.r_[False, key[1:] != key[:-1]]), np.arange(len(key))
        span = size.max() + 1
        end = np.searchsorted(bucket * span + size, bucket * span + np.minimum(size * 100 // percent, span - 1), side="right")
        others = end - row - 1
        total = np.cumsum(others)
        at = 0
        while at < len(key):
            until = max(int(np.searchsorted(total, total[at] - others[at] + LOOKED_AT, side="right")), at + 1)
            one = np.repeat(row[at:until], others[at:until])
            if len(one):
                yield one, one + 1 + np.arange(len(one)) - np.repeat(total[at:until] - others[at:until] - (total[at] - others[at]), others[at:until])
            at = until

    def run(batches):
        found, held = [], 0
        for rows in whole_buckets(batches):
            if rows.num_rows < 2:
                continue
            key, size = (rows.column(c).to_numpy() for c in ("key", "size"))
            order = np.lexsort((size, key))
            key, size = key[order], size[order]
            ids, part, pos, matches, rank, side = (rows.column(c).to_numpy()[order] for c in ("id", "component", "pos", "matches", "rank", "side"))
            start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            two_sided = np.repeat(np.logical_or.reduceat(side, start), np.diff(np.r_[start, len(key)]))
            leveled = first = None
            for one, other in row_pairs(key, size):
                apart = (part[one] != part[other]) & (~two_sided[one] | (side[one] != side[other]))
                one, other = one[apart], other[apart]
                need = np.minimum(matches[one], matches[other])
                least = -(-percent * (size[one] + size[other]) // (100 + percent))
                room = need - least
                inside = (pos[one] < size[one] + room) & (pos[other] < size[other] + room)
                one, other, need, least, room = (x[inside] for x in (one, other, need, least, room))
                if not len(one):
                    continue
                if leveled is None:
                    leveled = by_level(rows.column("map").take(pa.array(order)).to_pylist(), size)
                    first = np.frombuffer(b"".join(rows.column("first").take(pa.array(order)).to_pylist()), FIRST_ROW).reshape(-1, FIRST)
                new = np.flatnonzero(~told_before(one, other, room, size, rank, first))
                new = new[may_link(one[new], other[new], least[new], size, *leveled)]
                if len(new):
                    a, b = ids[one[new]], ids[other[new]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b), need[new]], axis=1))
                    held += len(new)
                if held >= 200_000:
                    yield pack(found)
                    found, held = [], 0
        if found:
            yield pack(found)

    def pack(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in range(3)], names=["a", "b", "need"])

    return bucketed.mapInArrow(run, "a long, b long, need long").distinct()


def matched(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, need) whose prefixes share as many tokens as they need, of those that the two sizes leave; `prefixes` is (id, size, prefix)."""

    def run(batches):
        for batch in batches:
            keep = []
            for need, size_x, x, size_y, y in zip(*(batch.column(c).to_pylist() for c in ("need", "size_x", "x", "size_y", "y"))):
                room = need - -(-percent * (size_x + size_y) // (100 + percent))
                x, y = np.frombuffer(x, np.uint64)[: size_x + room], np.frombuffer(y, np.uint64)[: size_y + room]
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name, column):
        return prefixes.select(F.col("id").alias(name), F.col("size").alias(f"size_{column}"), F.col("prefix").alias(column))

    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "need", "size_x", "x", "size_y", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, members) of the nodes `wanted` (id, doc_id), from the texts."""

    def build(hashes, counts, sets):
        distinct = [np.unique(s) for s in sets]
        return [set_keys(d)[0] for d in distinct], [d.tobytes() for d in distinct]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = over_sets(texts, size, "id long, members binary", build).select("id", "members")
    # a doc_id may have several rows, of one text or of different ones
    return sets.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def jaccard_classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets of `size`-word shingles linked at `percent` likeness."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plain = docs.select("doc_id", "text")
    heat = spark.sparkContext.broadcast(token_heat(plain, size))  # CELLS bytes
    described = cut_lineage(describe(plain, size, percent, heat))
    usable = described.where("n_shingles > 0 and doc_id is not null")
    keys = ["key_a", "key_b", "n_shingles"]
    nodes = usable.groupBy(*keys).agg(F.min(F.struct("doc_id", "prefix", "map")).alias("first"))
    nodes = cut_lineage(nodes.select(*keys, F.col("key_a").alias("id"), F.col("n_shingles").alias("size"), "first.*"))
    ordered = postings(nodes).repartition(parts, "key").sortWithinPartitions("key")
    chosen = cut_lineage(adapted(counted_postings(ordered), percent))
    involved = chosen.where("nth = 0").select("id")
    sets = cut_lineage(full_sets(plain, nodes.select("id", "doc_id").join(involved, "id", "left_semi"), size))

    def bucketed(rows: DataFrame, facts: DataFrame) -> DataFrame:
        return rows.join(facts, "id").repartition(parts, "key").sortWithinPartitions("key")

    facts = cut_lineage(chosen.where("nth = 0").select("id", "size", "matches", "first").join(nodes.select("id", "map", "prefix"), "id"))
    rarest = dealt_rows(chosen.where(F.col("nth") < TREE_TOKENS).select("key", "id", F.col("pos").alias("place")), BLOCK)
    trees = bucketed(rarest.select("key", "id"), facts.select("id", "size", "map")).select("key", "id", F.col("id").alias("component"), "size", "map")
    links = cut_lineage(verified(tree_edges(trees, percent), sets, percent))
    labels = components(links)
    rows = paired_rows(chosen.select("key", "id", F.struct("pos", "rank").alias("place")), labels, CELL).select("key", "id", "place.*", "side")
    placed = facts.drop("prefix").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = bucketed(rows, placed).select("key", "id", "component", "size", "pos", "matches", "rank", "side", "map", "first")
    pairs = matched(counted_pairs(apart, percent), facts.select("id", "size", "prefix"), percent)
    links = links.unionByName(cut_lineage(verified(pairs, sets, percent)))

    linked = nodes.select(*keys, "id", "doc_id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut_lineage(linked.join(least, "component").select(*keys, "component_id"))
    light = described.select("doc_id", *keys)
    apart = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    joined = light.where(~apart).join(named, keys).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(light.where(apart).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents"), size=3, percent=90)
