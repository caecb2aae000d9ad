"""Scores by hand-computed tables and properties; search, suggestions and comparison against full scoring and grouping."""

import itertools

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import compare, identity, search
from shelfwatch.plans.registry import Source
from shelfwatch.plans.searching import titles

FOLDER = "/root/testdata/sf0.001"

#: query, candidate, match score, comparison score. A ratio of two texts is twice the letters of their matching blocks over both lengths.
SCORED = [
    ("oak table", "solid oak table", 1.0, 0.9),  # contained; all words inside
    ("oak desk", "solid oak table", 0.7, 2 * 5 / 23),  # a pair of equal words; blocks "oak " and one letter
    ("lamp", "lamp", 1.0, 1.0),
    ("lamp", "red lamp", 1.0, 0.72),  # one word among several
    ("lamp", "lamp lamp", 1.0, 0.72),
    ("abcd", "bcda", 0.8 * 0.75, 0.75),  # "bcd" of four and four letters
    ("abcdx", "abcdy", 0.8 * 0.8, 0.8),
    ("x y", "y x", 0.9, 0.9),  # the same words in another order
    ("", "anything", 0.0, 0.0),
    ("anything", "", 0.0, 0.0),
]


def scored(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, c string")
    matched = [r.score for r in search.with_match_score(rows, F.col("q"), F.col("c")).orderBy("i").collect()]
    compared = [r.score for r in compare.with_comparison_score(rows, [(F.col("q"), F.col("c"))]).orderBy("i").collect()]
    return matched, compared


def test_hand_computed_scores(spark):
    matched, compared = scored(spark, [s[:2] for s in SCORED])
    assert matched == pytest.approx([s[2] for s in SCORED])
    assert compared == pytest.approx([s[3] for s in SCORED])


def test_score_properties(spark):
    words = ["amber", "ambar", "birch", "birches", "cedar wood", "wood cedar", "cedar", "c" * 250, "c" * 249 + "d"]
    pairs = list(itertools.product(words, words))
    matched, compared = scored(spark, pairs)
    for (q, c), m, k in zip(pairs, matched, compared):
        assert 0 <= m <= 1 and 0 <= k <= 1
        assert (k == 1) == (q == c)
        assert m == 1 if q in c else m < 1
        shared = len(set(q.split()) & set(c.split())) / len(set(q.split()))
        assert m >= 0.9 * shared - 1e-9
        if set(q.split()) < set(c.split()) and len(q.split()) > 1:
            assert k == pytest.approx(0.9)
    # The rule for long texts is that for short ones: one letter of 250 differs.
    assert compared[pairs.index((words[7], words[8]))] == pytest.approx(2 * 249 / 500)


def identities(spark, cases, hint=None):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, normalized_title string, category string")
    out = identity.with_identity(rows, base_hint=None if hint is None else F.lit(hint)).orderBy("i").collect()
    return [(r.base, r.mutation, r.display_title) for r in out]


def test_identities(spark):
    """Phrases are taken out in table order, once each; numbers and stat words go; without a variant the title is the base."""
    game = "Brainrot goods"
    expected = {
        ("tiny robot", game): ("tiny robot", "normal", "Tiny Robot"),
        ("magma tiny robot", game): ("tiny robot", "magma", "Magma Tiny Robot"),
        ("tiny lava robot 55m 2s", "anything"): ("tiny robot", "lava", "Lava Tiny Robot"),  # a quantity marks a game
        ("shadow robot", "Kitchen"): ("shadow robot", "normal", "Shadow Robot"),  # neither marker nor quantity
        ("cyber blood moon robot", game): ("robot", "blood moon cyber", "Blood Moon Cyber Robot"),
        ("blood cyber moon", game): ("blood moon", "cyber", "Cyber Blood Moon"),  # the pair is not together
        ("crystal crystal", game): ("crystal", "crystal", "Crystal Crystal"),  # the first one only
        ("electric", game): ("electric", "electric", "Electric Electric"),
        ("77 88", game): ("77 88", "normal", "77 88"),
        ("", None): ("", "normal", ""),
    }
    assert identities(spark, list(expected)) == list(expected.values())


def test_hint_splits_other_titles(spark):
    cases = [("galaxy tiny robot", "Kitchen"), ("galaxy tall robot", "Kitchen"), ("galaxy", "Kitchen")]
    split, kept = ("tiny robot", "galaxy", "Galaxy Tiny Robot"), ("galaxy tall robot", "normal", "Galaxy Tall Robot")
    assert identities(spark, cases, "tiny robot")[:2] == [split, kept]
    assert identities(spark, cases, "")[2] == ("galaxy", "normal", "Galaxy")  # an empty hint is none


def test_aliases(spark):
    rows = spark.createDataFrame([("silver gun",), ("guns",), ("silver",)], "t string")
    assert [r[0] for r in rows.select(identity.comparison_aliases(F.col("t"))).collect()] == [["silver gun", "silver"], ["guns"], ["silver"]]


def test_token_variants(spark):
    rows = spark.createDataFrame([("abcdefgh abcd abcde",), ("",)], "t string")
    assert [r[0] for r in rows.select(search.token_variants(F.col("t"))).collect()] == [["abcdefgh", "abcd", "abcdef", "abcde"], []]


@pytest.fixture(scope="module")
def market(spark):
    source = Source(spark, FOLDER)
    rows = titles(source).cache()
    shops = source.competitors.cache()
    return rows, shops, [r.asDict() for r in rows.collect()], {r.id: r.asDict() for r in shops.collect()}


def scores_of(rows, q, column="normalized_title"):
    """The match score of every product, without candidates."""
    return {r.id: r.score for r in search.with_match_score(rows, F.lit(q), F.col(column)).select("id", "score").collect()}


@pytest.mark.parametrize("q", ["Divine  Blue-Bolt", "rign", "zz"])
def test_search_ranks_all_scored_candidates(market, q):
    rows, shops, products, names = market
    norm = " ".join(q.lower().replace("-", " ").split())
    score = scores_of(rows, norm)
    starts = {v for t in norm.split() for v in (t, t[:4], t[:6]) if len(v) >= 2}
    hits = [p for p in products if any(v in p["normalized_title"] for v in starts) and score[p["id"]] >= 0.34]
    hits.sort(key=lambda p: (-round(score[p["id"]], 3), p["current_price"] is None, p["current_price"], p["id"]))
    got = search.search_products(rows, shops, q, page=1, page_size=40, blocked=True).orderBy("pos").collect()
    assert [(r.match_score, r.id, r.competitor_name) for r in got] == [(round(score[p["id"]], 3), p["id"], names[p["competitor_id"]]["name"]) for p in hits[:40]]
    assert search.search_results(rows, shops, q, blocked=True).count() == len(hits)
    assert search.search_results(rows, shops, q).count() == sum(x >= 0.34 for x in score.values())


def test_unblocked_search_finds_misspelt_beginnings(market):
    rows, shops, products, _ = market
    score = scores_of(rows, "xlue bolt")
    got = {r.id for r in search.search_results(rows, shops, "xlue bolt").collect()}
    assert got == {p["id"] for p in products if score[p["id"]] >= 0.34}
    assert {r.id for r in search.search_results(rows, shops, "xlue bolt", blocked=True).collect()} <= got


def test_candidate_limit(market):
    rows, _, products, _ = market
    got = {r.id for r in search.search_candidates(rows, "blue", 10, blocked=True).collect()}
    newest = sorted((p for p in products if "blue" in p["normalized_title"]), key=lambda p: (-p["last_checked_at"].timestamp(), p["id"]))
    assert got == {p["id"] for p in newest[:10]}


def test_suggestions_group_the_scored_candidates(market):
    rows, shops, products, names = market
    tagged = identity.with_identity(rows, base_hint=F.lit("blue bolt"))
    by_title, by_base = scores_of(rows, "blue bolt"), scores_of(tagged, "blue bolt", "base")
    product = {p["id"]: p for p in products}
    score = {i: max(by_title[i], by_base[i]) for i in product if {"blue", "bolt"} & {w for w in ("blue", "bolt") if w in product[i]["normalized_title"]}}
    groups = {}
    for r in tagged.select("id", "identity_key").collect():
        if score.get(r.id, 0) >= 0.34:
            groups.setdefault(r.identity_key, []).append(product[r.id])
    newest = lambda p: (-p["last_checked_at"].timestamp(), p["id"])
    facts = {}
    for key, members in groups.items():
        cheapest = min(members, key=lambda p: (p["current_price"] is None, p["current_price"], newest(p)))
        facts[key] = (round(max(score[p["id"]] for p in members), 3), len({names[p["competitor_id"]]["name"] for p in members}), cheapest["current_price"],
                      min(members, key=newest)["category"], cheapest["id"], sorted({p["title"] for p in members})[:5])
    order = sorted(facts, key=lambda k: (-facts[k][0], -facts[k][1], facts[k][2], k))
    got = search.search_suggestions(rows, shops, "blue bolt", blocked=True).orderBy("pos").collect()
    assert [r.identity_key for r in got] == order[:20]
    for r in got:
        assert (r.match_score, r.competitors_count, r.best_price, r.category, r.representative_product_id, list(r.variants)) == facts[r.identity_key]


def test_compare_takes_the_best_match_of_every_shop(market):
    rows, shops, _, names = market
    target = compare.compare_target(rows, q="divine blue bolt")
    wanted = identity.with_identity(target).first()
    pairs = [(a, b) for a in (F.lit(wanted.base),) for b in (F.col("base"),)]
    rivals = identity.with_identity(rows, base_hint=F.lit(wanted.base)).where(F.col("mutation") == wanted.mutation)
    scored_rivals = compare.with_comparison_score(rivals, pairs).where("score >= 0.86").collect()
    best = {}
    for r in scored_rivals:
        key = (-r.score, r.current_price, r.id)
        best[r.competitor_id] = min(best.get(r.competitor_id, key), key)
    got = {r.competitor_id: r for r in compare.compare_product(rows, shops, target).collect()}
    assert set(got) == {c for c, shop in names.items() if shop["active"]} and best
    for shop, r in got.items():
        if shop in best:  # aliases can only better a match
            assert r.match_score >= round(-best[shop][0], 3)
            assert r.match_score > round(-best[shop][0], 3) or (r.current_price, r.product_id) == best[shop][1:]
        else:
            assert r.product_id is None or r.match_score >= 0.86
    prices = [r.current_price for r in got.values() if r.product_id is not None]
    assert prices == sorted(prices)


def test_unknown_id_falls_back_to_the_query(market):
    rows, _, _, _ = market
    by_text = compare.compare_target(rows, q="divine blue bolt").first()
    assert compare.compare_target(rows, product_id=-1, q="divine blue bolt").first().id == by_text.id
    assert compare.compare_target(rows, product_id=by_text.id, q="zz").first().id == by_text.id
    assert compare.compare_target(rows, product_id=-1).count() == 0


def test_compare_with_generic_category_uses_target_base(spark):
    data = [(1, 1, "tiny robot", "Steal a Brainrot", "5.00"), (2, 2, "divine tiny robot", "Pets", "3.00"), (3, 2, "tiny robot", "Pets", "9.00"),
            (4, 3, "divine tiny robot", "Steal a Brainrot", "2.00"), (5, 3, "tiny robots", "x", None), (6, 4, "other", "x", "1.00")]
    rows = spark.createDataFrame(data, "id long, competitor_id long, normalized_title string, category string, current_price string").withColumns({
        "current_price": F.col("current_price").cast("decimal(12,2)"), "active": F.lit(True), "currency": F.lit("USD"), "last_checked_at": F.current_timestamp()})
    shops = spark.createDataFrame([(i, f"s{i}", True) for i in range(1, 5)], "id long, name string, active boolean")
    normal = {r.competitor_id: r.product_id for r in compare.compare_product(rows, shops, compare.compare_target(rows, product_id=1)).collect()}
    assert normal == {1: 1, 2: 3, 3: 5, 4: None}
    divine = {r.competitor_id: r.product_id for r in compare.compare_product(rows, shops, compare.compare_target(rows, product_id=4)).collect()}
    assert divine == {1: None, 2: 2, 3: 4, 4: None}
