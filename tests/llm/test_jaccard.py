"""The Jaccard join against brute force, and the guarantees of its prefixes."""

import random

import numpy as np
import pytest

from shelfwatch.llm import jaccard
from shelfwatch.llm.queries import LLM_JOBS
from tests.llm.test_dedup import copies_near_the_threshold, expected_components

SMALL = "/root/testdata/sf0.001"


def classes(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_planted_copies(spark, seed, size, percent):
    texts = copies_near_the_threshold(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = classes(jaccard.jaccard_classes(docs, size, percent))
    assert found == expected_components(texts, size, percent) and 4 < len({c for _, c in found.values()}) < len(texts)


def few_edits(seed, documents, words, most):
    """One template with a few words changed in each document, so that most pairs lie close to the threshold."""
    draw = random.Random(seed)
    base = [f"word{i}" for i in range(words)]
    texts = {}
    for i in range(documents):
        some = list(base)
        for _ in range(draw.randrange(0, most)):
            some[draw.randrange(words)] = draw.choice(["and", "the", f"own{draw.random()}"])
        texts[i] = " ".join(some)
    return texts


@pytest.mark.parametrize("cell", [jaccard.CELL, 16])
def test_large_groups_of_near_copies(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    texts = few_edits(6, 160, 120, 9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = classes(jaccard.jaccard_classes(docs, 3, 90))
    assert found == expected_components(texts, 3, 90) and 1 < len({c for _, c in found.values()}) < 160


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert classes(LLM_JOBS["op11_jaccard"](spark, SMALL)) == expected_components(texts, 3, 90)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = jaccard.jaccard_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [found[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1] and found[1].component_id == 1
    assert found[6].component_id == 5 and all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.jaccard_classes(no_docs).count() == 0


def test_one_id_with_two_texts(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "first text of its own"), (5, "first text of its own"), (5, long), (7, long + " more")] + [(9, long)] * 50
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in found}) == [(1, 3, 1), (5, 3, 1), (5, 98, 5), (7, 99, 5), (9, 98, 5)] and len(found) == 54


def linked(x, y, percent):
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_the_smaller_number_of_matches(percent):
    """Whatever number each of two linked sets chooses, their prefixes share the smaller of both."""
    draw = random.Random(percent)
    tried = 0
    for _ in range(3000):
        x = set(draw.sample(range(400), draw.randrange(1, 60)))
        y = set(x)
        for _ in range(draw.randrange(6)):
            y.symmetric_difference_update({draw.randrange(400)})
        if not y or not linked(x, y, percent):
            continue
        tried += 1
        shared = -(-percent * (len(x) + len(y)) // (100 + percent))
        assert len(x & y) >= shared >= max(jaccard.least_shared(len(s), percent) for s in (x, y))
        for m in range(1, shared + 1):
            px, py = (sorted(s)[: len(s) - shared + m] for s in (x, y))
            assert len(set(px) & set(py)) >= m
    assert tried > 300


def test_the_choice_is_the_cheapest_and_drops_only_the_impossible():
    rare, common = np.array([2, 2, 2, 2]), np.array([2, 500, 500, 500])
    assert jaccard.chosen_matches(100, np.arange(11), np.full(11, 2), 90) == 0  # a prefix of 12 has 11 shared tokens, yet 13 need not
    places = np.arange(26)
    assert jaccard.chosen_matches(100, places, np.full(26, 50), 90) > jaccard.chosen_matches(4, np.arange(4), rare, 90) >= 1
    assert jaccard.chosen_matches(100, places, np.r_[np.full(12, 2), np.full(14, 10**6)], 90) == 2  # longer prefixes meet frequent tokens
    assert jaccard.chosen_matches(4, np.array([1, 2, 3]), common[1:], 90) == 0  # its first token is nobody else's


@pytest.mark.parametrize("most", [jaccard.COUNTED, 10])
def test_counts_of_keys_over_many_batches(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "COUNTED", most)
    draw = random.Random(9)
    keys = [k for k, n in enumerate([1, 2, 1, 30, 1, 1, 9, 7, 7, 14, 1, 2, 21, 1]) for _ in range(n)]
    rows = spark.createDataFrame([(k, i, 5, draw.randrange(9)) for i, k in enumerate(keys)], "key long, id long, size long, pos int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = jaccard.counted_postings(rows.coalesce(1).sortWithinPartitions("key")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, i, keys.count(k)) for i, k in enumerate(keys) if keys.count(k) > 1]
    assert sorted((r.key, r.id) for r in found) == [w[:2] for w in want]
    assert all(r.df == keys.count(r.key) or r.df >= most for r in found)


def tokens(draw, n):
    return np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))


@pytest.mark.parametrize("n", [20, 850, 940, 1700, 1850, 3550, 3700, 7000, 7300, 20_000])
def test_maps_of_sets(n):
    """Maps of one level and of neighbours never tell of more tokens than a set has alone, and tell strangers of any size apart."""
    draw = np.random.default_rng(n)
    x = tokens(draw, n)
    for kept in (n, n - n // 40, n - n // 10, n // 2, n // 10):
        y = np.unique(np.r_[x[draw.permutation(n)[:kept]], tokens(draw, n + n // 20 - kept)])
        levels = [int(jaccard.map_level(len(s))) for s in (x, y)]
        first, other = (jaccard.stacked([jaccard.set_map(s)]) for s in (x, y))
        if levels[1] > levels[0]:
            other = jaccard.halved(other)
        words = min(first.shape[1], other.shape[1])
        first, other = first[:, :words], other[:, :words]
        only_x, only_y = jaccard.only_in(first, other)[0], jaccard.only_in(other, first)[0]
        shared = len(np.intersect1d(x, y))
        assert 0 <= only_x <= len(x) - shared and 0 <= only_y <= len(y) - shared
        if n > 100 and kept <= n // 10:  # likeness far below 0.9
            assert min(len(x) - only_x, len(y) - only_y) < -(-90 * (len(x) + len(y)) // 190)


def test_long_texts_with_a_few_phrases_in_common(spark, monkeypatch):
    """No pair of theirs is counted, though all share tokens of their prefixes."""
    draw = random.Random(8)
    phrases = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(30)]
    texts = {}
    for i in range(24):
        own = [f"w{draw.random()}" for _ in range(4000 if i % 2 else 6000)]
        texts[i] = " ".join([*own[:2000], *draw.sample(phrases, 20), *own[2000:]])
    texts[24] = texts[0].replace("p3x4", "other")
    seen, counted = [], jaccard.counted_pairs
    monkeypatch.setattr(jaccard, "counted_pairs", lambda rows, percent: counted(Watched(rows, seen), percent))
    found = classes(jaccard.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90))
    assert seen == [0]
    assert {i: c for i, (_, c) in found.items()} == {i: 0 if i == 24 else i for i in texts}


@pytest.mark.parametrize("looked_at, batch", [(jaccard.LOOKED_AT, 10_000), (50, 7)])
def test_a_pair_is_told_once_and_not_per_token(spark, monkeypatch, looked_at, batch):
    """Near copies below the threshold share most tokens, which lie in all partitions."""
    monkeypatch.setattr(jaccard, "LOOKED_AT", looked_at)
    draw = random.Random(11)
    base = [f"word{i}" for i in range(800)]
    texts = {}
    for i in range(30):
        some = list(base)
        for place in draw.sample(range(800), 3 if i < 4 else 12):
            some[place] = f"own{draw.random()}"
        texts[i] = " ".join(some)
    seen, counted = [], jaccard.counted_pairs
    monkeypatch.setattr(jaccard, "counted_pairs", lambda rows, percent: counted(Watched(rows, seen), percent))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = classes(jaccard.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == expected_components(texts, 3, 90) and len({c for _, c in found.values()}) > 10
    assert 100 < seen[0] <= 30 * 29 // 2


class Watched:
    """Rows whose `mapInArrow` tells how many rows it makes."""

    def __init__(self, rows, made):
        self.rows, self.made = rows, made

    def mapInArrow(self, run, schema):
        out = self.rows.mapInArrow(run, schema)
        self.made.append(out.count())
        return out
