"""Toxicity, mixing, archives, top-k search, fingerprints, licenses: brute force, round trips and odd rows."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwatch.llm import fingerprints, licenses, mixing, topk, toxicity, warc
from shelfwatch.session import scratch_path

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# toxicity

def test_folding():
    table = toxicity.fold_table()
    for text in ("l0ser", "1oser", "LOSER", "lоsеr", "ｌｏｓｅｒ", "lo​ser", "l0$er", "!loser!"):
        assert "ioser" in toxicity.fold(text, table).replace(" ", "")
    assert toxicity.fold("d1sgu$t1ng!", table) == " disgusting " and toxicity.fold("", table) == "  "


def test_folding_beyond_the_first_planes():
    table = toxicity.fold_table()
    assert toxicity.fold("𝐋𝖔𝓼𝑒𝚛 🅻oser", table).split()[0] == "ioser"
    assert toxicity.fold("😀scum😀 ∀scum→", table) == " scum scum "
    assert toxicity.fold("日本", table) == " 日本 "


def test_matches_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " scu": 1.0}, (" trash bin ",), 4.0, -3.0)
    matcher = toxicity.Matcher(lexicon)
    hits = lambda text: [m[3] for m in matcher.matches(toxicity.fold(text, matcher.table))]
    assert hits("you trash, you scum") == [" trash ", " scu"]
    assert hits("a trash bin") == [] and hits("trashy") == [] and hits("tr4sh bin, trash") == [" trash "]
    assert matcher.score("trash scum")[0] > matcher.score("trash " + "word " * 500)[0] > matcher.score("")[0]


def test_held_out_accuracy(spark):
    scored = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = scored.where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= 0.8 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    lexicon = toxicity.Lexicon({" same": 5.0}, (), 4.0, -3.0)
    rows = toxicity.score_documents(odd_docs, lexicon, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(odd_docs, lexicon).schema == odd_docs.schema
    assert toxicity.score_documents(no_docs, lexicon, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn_lexicon(odd_docs, labels).weights == {}  # one kind of label only


# mixing

def refilled(sizes, weights, share, cap):
    """Targets by giving out what is left again and again until no source is above its cap."""
    wanted, closed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in closed]
        left, weight = wanted - sum(closed.values()), sum(weights[i % 3] for i in free)
        over = [i for i in free if left * weights[i % 3] / weight > cap * sizes[i]]
        if not over:
            return [closed.get(i, left * weights[i % 3] / weight if weight else 0.0) for i in range(len(sizes))]
        closed |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1, 50], [5, 0, 900, 40, 40, 3], [7], [0, 0]])
def test_targets_by_refilling(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert [found[f"s{i}"] for i in range(len(sizes))] == pytest.approx(refilled(sizes, mixing.WEIGHTS, 1.5, 2.0))


def test_schedule_inversion(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))):
        times, weights = np.array(knots).T
        grid = np.linspace(0, 1, 2001)
        rate = np.interp(grid, times, weights)
        done = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))]
        shares = [i / 40 for i in range(41)]
        frame = spark.createDataFrame([(s,) for s in shares], "s double")
        found = [r[0] for r in frame.select(mixing.invert_schedule(F.col("s"), knots)).collect()]
        assert np.interp(found, grid, done) == pytest.approx(np.array(shares) * done[-1], abs=2e-3)


def test_mix_of_odd_rows(odd_docs, no_docs):
    planned = mixing.plan_mix(odd_docs.drop("size")).cache()
    assert planned.count() == odd_docs.count()
    for source in planned.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(source.taken - source.target) <= source.largest / 2 + 1e-6
    assert planned.where("taken > 2 * size or (size = 0 and taken > 0)").count() == 0
    order = mixing.training_order(planned, ["doc_id"]).collect()
    assert len(order) == planned.agg(F.sum("passes")).first()[0]
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert mixing.plan_mix(no_docs).count() == 0


def test_mix_is_read_off_the_training_order(spark, odd_docs, monkeypatch):
    whole = mixing.trained(mixing.plan_mix(odd_docs.drop("size"))).collect()
    assert len(whole) == odd_docs.count()
    sort = mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda *a: sort(*a).where("position < 0.5"))
    half = mixing.op4_mixing(spark, "/root/testdata/sf0.001")
    assert half.agg(F.max("first_position")).first()[0] < 0.5


# archives

def members(n, seed=1):
    draw = random.Random(seed)
    payloads = [draw.randbytes(draw.randrange(0, 3000)) for _ in range(n)]
    return [(i, f"http://host/{i} x", p) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("split", [50, 777, 10_000, 1 << 22])
def test_every_split_reads_every_record_once(spark, split):
    rows = members(60)
    records = [(i, u, p, hashlib.sha1(p).hexdigest(), None) for i, u, p in rows]
    frame = spark.createDataFrame(records, "page_id long, url string, payload binary, digest string, refers_to long").coalesce(2)
    manifest = warc.write_archives(frame, warc.store_uri(spark, scratch_path(spark, "warc")))
    found = warc.read_archives(manifest, split).collect()
    assert sorted((r.page_id, bytes(r.payload), r.payload_digest) for r in found) == [(i, p, d) for i, _, p, d, _ in records]
    assert {r.target_uri for r in found} == {f"http://host/{i}%20x" for i in range(60)}


def test_false_magic_is_no_member():
    import zlib

    def gzip(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    first = gzip(warc.encode_record(1, None, warc.MAGIC + b"\x00" * 30 + b"payload", "d", None, "now"))
    data = warc.MAGIC + b"no member" + first + gzip(b"not a record") + gzip(warc.encode_record(2, None, b"", "d", None, "now"))

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    for step in (7, 1 << 20):
        found = [warc.decode_record(r)[0]["WARC-Record-ID"] for r in warc.records_in(File(), len(data), 0, len(data) - 1, step)]
        assert found == ["<urn:page:1>", "<urn:page:2>"]
    assert list(warc.records_in(File(), len(data), len(warc.MAGIC) + 10, len(warc.MAGIC) + 20)) == []


def test_revisits_and_odd_pages(spark):
    long = "é" * 600
    rows = [(1, "u", long), (2, None, long), (2, "again", long), (None, "v", long), (3, "w", "short"), (4, "w", "short"), (5, "w", None), (None, None, "lone" * 300)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    marked = warc.mark_revisits(pages)
    manifest = warc.write_archives(marked, warc.store_uri(spark, scratch_path(spark, "warc")))
    found = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(manifest).collect()]
    expected = [(1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (None, "revisit", 2, 1200)]
    expected += [(3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "response", None, 1200)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    empty = warc.write_archives(marked.where("false"), warc.store_uri(spark, scratch_path(spark, "warc")))
    assert warc.read_archives(empty).count() == 0


# top-k search

def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [random.Random(i).uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [1.0, None]), (305, [nan] * 6), (306, [inf] * 6), (307, [1.0, 2.0]), (308, [2.0, 1.0]), (None, rows[1][1]), (7, rows[8][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = topk.top_k(frame, "embedding", F.col("vec_id") % 7 == 0, k=4, per_shard=60, leaf_size=8)
    usable = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = set()
    by_query = {}
    for q, v in usable:
        if q % 7 == 0:
            by_query.setdefault(q, set()).update((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))
    for q, scores in by_query.items():
        if q != 7:
            expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:4], 1)}
    rows_found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    assert {r for r in rows_found if r[0] != 7} == expected
    assert topk.top_k(frame.where("false"), "embedding", F.col("vec_id") % 7 == 0).count() == 0


def test_a_task_searches_one_tree_with_one_block(spark, monkeypatch, tmp_path):
    seen, plain = str(tmp_path), topk.search_tree

    def watched(nodes, own, queries, bounds, k):
        (Path(seen) / f"{random.SystemRandom().random()}").write_text(str(len(own)))
        return plain(nodes, own, queries, bounds, k)

    monkeypatch.setattr(topk, "search_tree", watched)
    rows = [(i, [random.Random(i).uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    rows += [(1, [0.5] * 4)] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = sorted(topk.top_k(frame, "embedding", F.lit(True), k=3, per_shard=100, block=16).collect())
    sizes = [int(p.read_text()) for p in Path(seen).iterdir()]
    assert sizes and max(sizes) <= 16 and len(sizes) >= 4 * 400 / 16
    assert few == sorted(topk.top_k(frame, "embedding", F.lit(True), k=3, per_shard=1000, block=100_000).collect())


def test_rounds_pass_the_bound_on(spark, monkeypatch):
    """Hits of a query grow with the number of rounds, not of shards."""
    hits, plain = [], topk.search_shards
    monkeypatch.setattr(topk, "search_shards", lambda *a: hits.append(plain(*a)) or hits[-1])
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=32)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, "embedding", F.col("vec_id") % 50 == 0, k=5, per_shard=100).collect()
    points = np.array([np.floor(256 * np.array(v)).astype(int) for _, v in rows])
    for q in range(0, 3000, 50):
        scores = points @ points[q]
        scores[q] = -(2**40)
        assert [r.score for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == sorted(scores.tolist(), reverse=True)[:5]
    assert len(hits) == 6 and sum(h.count() for h in hits) <= 60 * 5 * 10  # of 60 * 5 * 30 without bounds


def test_large_components_are_exact():
    a, b = np.array([[2**40, 3]]), np.array([[2**20, 5], [-(2**20), 1]])
    assert topk.exact_dot(a, b).tolist() == [[2**60 + 15, -(2**60) + 3]]


# fingerprints

def test_edits_and_likeness(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(docs, reverse=True)
    expected = {}
    for i, d in enumerate(order):
        text, following = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        expected[d] = (len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())
    for buckets in (1, 7, None):
        rows = fingerprints.fingerprint_edits(spark.read.parquet(f"{SMALL}/documents.parquet"), buckets).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == expected and len(rows) == len(docs)
    texts = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert texts.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in rows]) > 0.25 > np.mean([r.near_next for r in rows])


def test_sketches_estimate_overlap():
    draw = random.Random(1)
    a = "".join(draw.choice("abcdefgh ") for _ in range(40_000))
    part, whole = fingerprints.sketches([a[:10_000], a])
    assert fingerprints.containment(part, whole) == 1.0 and abs(fingerprints.containment(whole, part) - 0.25) < 0.05
    assert (fingerprints.merge(part, whole) == whole).all()
    assert (fingerprints.read_fingerprint(fingerprints.fingerprint(whole)) == whole).all()


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    rows = fingerprints.fingerprint_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count() and fingerprints.fingerprint_edits(no_docs).count() == 0
    same = {r.fingerprint for r in rows if r.n_chars == 38}
    assert len(same) == 1
    single = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh" * 5)], "doc_id long, text string")).first()
    assert single.near_next == 1.0


# licenses

def test_alignment():
    assert licenses.patience_align("a b c d".split(), "a x c d".split()) == [(0, 0), (2, 2), (3, 3)]
    assert licenses.rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice("abcdefghij") for _ in range(draw.randrange(0, 14))] for _ in range(2))
        pairs = licenses.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_notices_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES.items():
        padded = "Some words before. " * 50 + text.upper() + " and the words after it, of the text" * 50 + text
        hits = scanner.scan(padded)
        assert (1.0, name) in [h[:2] for h in hits]
        first, last = next(h[2:] for h in hits if h[1] == name)
        assert licenses.WORD.findall(padded[first:last].lower()) == licenses.WORD.findall(text.lower())
    assert scanner.scan("") == [] and scanner.scan("The license of the work is not stated, version 3.") == []
    words = licenses.TEMPLATES["MIT permission"].split()
    del words[3::9]
    assert scanner.scan(" ".join(words))[0][1] == "MIT permission"


def test_near_miss_notices_and_every_place():
    scanner = licenses.Scanner(*(lambda t, d: (t, 0.8, d))(*licenses.all_templates()))
    names = lambda text: {h[1].split()[0] for h in scanner.scan(text)}
    expected = {
        "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0"}, "Licensed under CC BY 4.0.": {"CC-BY-4.0"}, "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0"},
        "Released under the BSD License.": {"BSD"}, "Licensed under the Apache License, Version 1.1": {"Apache-1.1"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"},
        "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0"},
        "Distributed under the MIT License.": {"MIT"}, "Licensed under the Apache License 2.0": {"Apache-2.0"}, "Licensed under the ISC License": {"ISC"},
        "// SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0-only"}, "Licensed under the Mozilla Public License, v. 2.0": {"MPL-2.0"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        "Released under the Unknown License.": set(), "Licensed under CC BY-NC 1.0.": set(),
    }
    assert {text: names(text) for text in expected} == expected
    for name, (text, _) in licenses.LONG.items():
        assert scanner.scan("before " * 300 + text + " after" * 300)[0][:2] == (1.0, name)
    for name in licenses.TEXTS:
        whole = (Path(licenses.__file__).with_name("license_texts") / f"{name}.txt").read_text()
        assert (1.0, f"{name} text") in [h[:2] for h in scanner.scan("before " * 50 + whole + " after" * 50)]
    line = "Released under the MIT License. "
    assert [h[2] for h in scanner.scan(line + "word " * 40 + line + line) if h[1] == "MIT"] == [0, 232, 264]


def test_licenses_of_documents(spark, odd_docs, no_docs):
    lines = {"Licensed under the Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()}
    for r in licenses.op10_licenses(spark, MIDDLE).collect():
        for line, name in lines.items():
            assert (line in docs[r.doc_id]) == (name in r.licenses.split(", "))
    assert licenses.scan_licenses(odd_docs, ["doc_id"]).where("license is null").count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs, ["doc_id"]).count() == 0


def test_queries_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
