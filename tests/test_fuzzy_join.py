"""The similarity join and the comparison of all products against nested loops."""

import random
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import compare, fuzzy_join, search
from shelfwatch.operators.identity import with_identity


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def misspelt(seed, n, words=3):
    """Few titles and many misspelt forms of them, of one to thirty characters."""
    draw = random.Random(seed)
    stock = ["amber", "birch", "cedar", "lamp", "shelf", "desk", "xl", "a", "of", "ottoman", "knife", "blue", "bluebell"]
    texts = set()
    while len(texts) < n:
        text = " ".join(draw.choice(stock) for _ in range(draw.randrange(1, words + 1)))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(text))
            text = draw.choice([text[:at] + text[at + 1 :], text[:at] + draw.choice("abz") + text[at:], text[:at] + draw.choice("abz") + text[at + 1 :]]) or "q"
        texts.add(" ".join(text.split()) or "q")
    return sorted(texts)


def frame(spark, texts):
    return spark.createDataFrame([(t, "clash") for t in [*texts, None, ""]], "text string, q string")


@pytest.mark.parametrize("least, cell", [(0.86, fuzzy_join.CELL), (0.86, 5), (0.7, fuzzy_join.CELL)])
def test_join_equals_all_pairs(spark, least, cell):
    left, right = misspelt(1, 150), misspelt(2, 150)
    found = {(r.a, r.b): r.ratio for r in fuzzy_join.similar_texts(frame(spark, left), frame(spark, right), least, cell).collect()}
    want = {(a, b): ratio(a, b) for a in left for b in right if a != b and ratio(a, b) >= least}
    assert found == want and len(want) > 20


def test_contained_texts(spark):
    left, right = misspelt(3, 120, 4), misspelt(4, 120, 6)
    left.append("lamp lamp")
    found = {(r.a, r.b) for r in fuzzy_join.contained_texts(frame(spark, left), frame(spark, right), 3).collect()}
    want = {(a, b) for a in left for b in right if a != b and len(a.split()) > 1 and set(a.split()) <= set(b.split())}
    assert found == want and want


def test_shared_letters_bound_the_ratio(spark):
    texts = misspelt(5, 40)
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").withColumn("n", fuzzy_join.shared_letters(F.col("a"), F.col("b")))
    for r in rows.collect():
        assert 2 * r.n / (len(r.a) + len(r.b)) >= ratio(r.a, r.b) and r.n == sum(min(r.a.count(x), r.b.count(x)) for x in set(r.a))


@pytest.fixture(scope="module")
def products(spark):
    draw = random.Random(6)
    titles = misspelt(7, 60) + ["divine amber lamp", "divine amber", "amber lamp", "galaxy birch 210m 1s", "birch", "birch knife"]
    rows = [(i, draw.randrange(4), draw.choice(titles), draw.choice(["Steal a Brainrot", "Lamps", None]), None if draw.random() < 0.1 else Decimal(draw.randrange(1, 20)),
             "USD", draw.random() < 0.9) for i in range(400)]
    return spark.createDataFrame(rows, "id long, competitor_id long, normalized_title string, category string, current_price decimal(12,2), currency string, active boolean")


def test_all_targets_at_once_equal_one_by_one(spark, products):
    shops = spark.createDataFrame([(i, f"shop {i}", True) for i in range(4)], "id long, name string, active boolean")
    found = {(r.base, r.mutation, r.competitor_id): (r.match_score, r.product_id) for r in compare.market_comparison_fuzzy(products).collect()}
    named = with_identity(products).select("id", "base", "mutation").collect()
    first = {}
    for r in named:
        first.setdefault((r.base, r.mutation), r.id)
    some = random.Random(8).sample(sorted(first), 12)
    for base, mutation in [*some, ("amber lamp", "normal")]:
        rows = compare.compare_product(products, shops, compare.compare_target(products, product_id=first.get((base, mutation)))).collect()
        for r in rows:
            assert found.get((base, mutation, r.competitor_id), (0.0, None)) == (r.match_score, r.product_id)
    assert {k[:2] for k in found} <= set(first)


def test_plan_compares_no_cartesian_product(products):
    plan = compare.market_comparison_fuzzy(products)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cell", [20_000, 3])
def test_many_queries_find_what_each_finds(spark, cell):
    queries, titles = misspelt(9, 60, 4) + ["x y", "skyblue bell"], misspelt(10, 100, 4)
    rows = spark.createDataFrame([(i, t, True, 0) for i, t in enumerate(titles)], "id long, normalized_title string, active boolean, last_checked_at int")
    found = {(r.query, r.title) for r in search.candidates_of_many(
        spark.createDataFrame([(q,) for q in [*queries, *queries, None, ""]], "query string"), spark.createDataFrame([(t,) for t in [*titles, None]], "title string"), cell).collect()}
    want = set()
    for q in queries:
        variants = {v for w in q.split() for v in (w, *([w[:4]] if len(w) > 4 else []), *([w[:6]] if len(w) > 6 else [])) if len(v) >= 2}
        want |= {(q, t) for t in titles if any(v in t for v in variants)}
    assert found == want and len(want) > 100
    one = queries[0]
    assert {t for q, t in found if q == one} == {r.normalized_title for r in search.search_candidates(rows, one, blocked=True).collect()}


def test_the_best_hits_of_many_queries(spark):
    texts = misspelt(11, 30)
    frame_of = lambda name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    every = search.search_many(frame_of("query"), frame_of("title")).collect()
    best = search.search_many(frame_of("query"), frame_of("title"), limit=2).collect()
    assert all(r.match_score == 1.0 for r in every if r.query == r.title) and len(best) <= 60
    for q in {r.query for r in every}:
        scores = sorted((r.match_score for r in every if r.query == q), reverse=True)[:2]
        assert sorted((r.match_score for r in best if r.query == q), reverse=True) == scores
