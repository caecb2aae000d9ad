"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random
import re

import pytest

from shelfwatch.llm import neardup, substrings
from shelfwatch.llm.queries import LLM_JOBS

SMALL = "/root/testdata/sf0.001"


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def expected_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def copies_near_the_threshold(seed):
    """A text, and chains of copies with more and more words replaced, so that likeness passes the threshold inside a chain."""
    draw = random.Random(seed)
    texts = {}
    for chain in range(4):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice((40, 200, 400)))]
        for _ in range(25):
            texts[len(texts)] = " ".join(words)
            for _ in range(draw.randrange(0, max(2, len(words) // 40))):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
    return texts


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 85), (2, 5, 80)])
def test_planted_copies(spark, seed, size, percent):
    texts = copies_near_the_threshold(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size, percent).collect()}
    assert found == expected_components(texts, size, percent)


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    expected = expected_components(texts, 3, 85)
    for r in LLM_JOBS["op2_neardup"](spark, SMALL).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [found[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    assert found[6].component_id == 5 and not found[6].kept and found[5].kept
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_signatures_within_the_threshold_share_a_key():
    """Pigeonhole: fewer errors than twice the chunks leave a chunk with one at most."""
    draw = random.Random(3)
    for _ in range(300):
        wrong = draw.sample(range(neardup.INDEXED), 2 * neardup.CHUNKS - 1)
        assert min(sum(w // neardup.PER_CHUNK == c for w in wrong) for c in range(neardup.CHUNKS)) <= 1


def expected_repeats(texts):
    seen, size = {}, substrings.LENGTH
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - size + 1):
            seen[d[i : i + size]] = seen.get(d[i : i + size], 0) + 1
    out = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
        kept = bytes(b for b, m in zip(d, mark) if not m)
        out.append((len(d), sum(mark), len([r for r in bytes(mark).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed):
    draw = random.Random(seed)
    letters = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [letters(n) for n in (150, 180, 199, 200, 201, 230, 500)]
    texts = [letters(draw.randrange(0, 300)) + draw.choice(passages) + letters(draw.randrange(0, 300)) for _ in range(40)]
    texts += ["ab" * 300, "q" * 250, "q" * 201, "q" * 199, passages[-1] * 2, texts[0], texts[1], passages[-1][:300], "é" * 150, "x" + "é" * 150]
    return texts


@pytest.mark.parametrize("hot", [substrings.HOT_LEAD, 2])
def test_planted_repeats(spark, hot):
    texts = repeated_texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in substrings.find_repeats(docs, hot).collect():
        runs = substrings.cover(r.n_bytes, [(s["first"], s["last"]) for s in r.spans or []])
        found[r.doc_id] = (r.n_bytes, sum(b - a for a, b in runs), len(runs))
    assert [found[i] for i in range(len(texts))] == [e[:3] for e in expected_repeats(texts)]


def test_op5_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected = dict(zip([d for d, _ in docs], expected_repeats([t for _, t in docs])))
    for r in LLM_JOBS["op5_substrings"](spark, SMALL).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id]


def test_substrings_of_odd_rows(odd_docs, no_docs):
    rows = substrings.without_repeats(odd_docs, ["doc_id", "score"]).collect()
    left = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert left[3] == "one" and left[0] == "" and 7 not in left and 9 not in left
    assert sum(r.doc_id is None for r in rows) == 2
    assert substrings.find_repeats(no_docs.select("doc_id", "text")).count() == 0


def test_whole_characters():
    data = "aéb".encode()
    assert substrings.whole_characters(data, [(2, 4)]) == [(3, 4)] and substrings.whole_characters(data, [(0, 2)]) == [(0, 1)]


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = repeated_texts(5)[0].encode() * 3
    whole = substrings.anchors([text])
    monkeypatch.setattr(substrings, "SLICE_BYTES", 500)
    stretches = substrings.anchors([text])
    assert set(zip(stretches[1].tolist(), stretches[2].tolist())) >= set(zip(whole[1].tolist(), whole[2].tolist()))


def test_large_buckets_are_dealt_and_lose_no_pair(spark):
    draw = random.Random(5)
    parts = {i: draw.choice([1, 1, 1, 2, 2, *range(3, 40)]) for i in range(300)}
    rows = spark.createDataFrame([(7, i, 3) for i in parts] + [(8, i, 3) for i in range(5)], "key long, id long, place int")
    labels = spark.createDataFrame(list(parts.items()), "id long, component long")
    groups = {}
    for r in neardup.paired_rows(rows, labels, 20).collect():
        groups.setdefault(r.key, []).append((r.id, r.side))
    assert max(map(len, groups.values())) <= 80
    told = set()
    for members in groups.values():
        split = any(side for _, side in members)
        told |= {tuple(sorted((a, b))) for a, s in members for b, z in members if a < b and (s != z or not split)}
    assert {(a, b) for a in parts for b in parts if a < b and parts[a] != parts[b]} <= told
    sizes = neardup.dealt_rows(rows, 20).groupBy("key").count().collect()
    assert sum(r["count"] for r in sizes) == 305 and max(r["count"] for r in sizes) <= 60
    alone = labels.withColumn("component", labels.component * 0)
    assert neardup.paired_rows(rows, alone, 20).count() == 5


def test_links_do_not_depend_on_the_cells(spark, monkeypatch):
    draw = random.Random(6)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.randrange(0, 9)):
            words[draw.randrange(len(words))] = f"own{draw.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(neardup.near_duplicates(docs, 3, 85).collect())
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "CELL", 16)
    assert sorted(neardup.near_duplicates(docs, 3, 85).collect()) == plain and 1 < len({r.component_id for r in plain}) < 150
