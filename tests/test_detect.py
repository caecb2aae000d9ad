"""Scan batches by rules over the keys of catalog and batch, by golden cases, and folded over time against the history replay."""

from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwatch.operators import detect, history
from shelfwatch.schemas import ITEM_SCHEMA, SCAN_SCHEMA, STATE_COLUMNS, STATE_SCHEMA

NOW = "2024-02-01 00:00:00"
BEFORE = "2024-01-01 00:00:00"


price = st.sampled_from([None, Decimal("1.00"), Decimal("2.50"), Decimal("0.00")])
fields = dict(
    title=st.sampled_from(["t1", "t2"]),
    category=st.sampled_from(["", "c1", "c2", None]), price=price, currency=st.sampled_from(["USD", "EUR"]),
    stock=st.sampled_from(["in_stock", "out_of_stock", "unknown"]),
)
catalogs = st.dictionaries(
    st.sampled_from(["u1", "u2", "u5", "u6"]), st.fixed_dictionaries({**fields, "misses": st.integers(0, 3)}), max_size=4
)
batches = st.dictionaries(st.sampled_from(["u1", "u2", "u3", "u5"]), st.fixed_dictionaries(fields), max_size=4)


def run(spark, catalog_by_shop, items_by_shop):
    state_rows = [
        (c, f"p{c}-{i}", p["url"], p["ext"], p["title"], p["title"], p["category"], None, p["price"], p["currency"], p["stock"], None,
         None, None, None, p["active"], p["misses"])
        for c, ps in catalog_by_shop.items() for i, p in enumerate(ps)
    ]
    state = spark.createDataFrame(state_rows, STATE_SCHEMA).withColumns({
        n: F.lit(BEFORE).cast("timestamp") for n in ("first_seen_at", "last_seen_at", "last_checked_at")})
    item_rows = [
        (c, it["ix"], it["url"], it["ext"], it["title"], it["price"], it["currency"], it["stock"], None, None, it["category"])
        for c, its in items_by_shop.items() for it in its
    ]
    scans = spark.createDataFrame([(c, True) for c in items_by_shop], SCAN_SCHEMA)
    return detect.apply_scan(state, spark.createDataFrame(item_rows, ITEM_SCHEMA), scans, NOW, keep_sequence=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(catalogs, batches), min_size=6, max_size=12))
def test_rules_over_keys(spark, cases):
    """What a batch does follows from the urls that only one side has and the values in which both sides differ."""
    stored = {c: [{**p, "url": u, "ext": None, "active": p["misses"] < 3} for u, p in ps.items()] for c, (ps, _) in enumerate(cases)}
    batch = {c: [{**it, "url": u, "ext": None, "ix": i} for i, (u, it) in enumerate(its.items())] for c, (_, its) in enumerate(cases)}
    result = run(spark, stored, batch)
    urls = {(c, it["ix"]): it["url"] for c, its in batch.items() for it in its}
    events = Counter((e.competitor_id, urls.get((e.competitor_id, e.item_ix)), e.event_type) for e in result.events.collect())
    snapshots = {(r.competitor_id, urls[r.competitor_id, r.item_ix]) for r in result.snapshots.collect()}
    state = {(r.competitor_id, r.url): r for r in result.state.collect()}
    old = {(c, p["url"]): p for c, ps in stored.items() for p in ps}
    new = {(c, it["url"]): it for c, its in batch.items() for it in its}
    both, added, missing = old.keys() & new.keys(), new.keys() - old.keys(), old.keys() - new.keys()

    def category(k):
        return new[k]["category"] or (old[k]["category"] if k in both else new[k]["category"])

    of_price = {k for k in both if old[k]["price"] != new[k]["price"]}
    known = {k for k in of_price if None not in (old[k]["price"], new[k]["price"])}
    of_stock = {k for k in both if old[k]["stock"] != new[k]["stock"]}
    removed = {k for k in missing if old[k]["misses"] == 2}
    expected = Counter([(*k, "new_product") for k in added])
    expected.update((*k, "price_changed") for k in of_price - known)
    expected.update((*k, "price_increase" if old[k]["price"] < new[k]["price"] else "price_decrease") for k in known)
    expected.update((*k, "stock_in" if new[k]["stock"] == "in_stock" else "stock_out") for k in of_stock)
    expected.update((k[0], None, "product_removed") for k in removed)
    assert events == expected
    described = {k for k in both if old[k]["title"] != new[k]["title"] or category(k) != old[k]["category"]}
    assert snapshots == added | of_price | of_stock | described
    assert state.keys() == old.keys() | new.keys()
    for k, row in state.items():
        if k in new:
            assert (row.active, row.consecutive_misses, row.title, row.price, row.stock_status) == (True, 0, new[k]["title"], new[k]["price"], new[k]["stock"])
            assert row.category == category(k)
            assert row.currency == (new[k] if k in added | of_price else old[k])["currency"]
        else:
            assert row.consecutive_misses == old[k]["misses"] + old[k]["active"] and row.active == (row.consecutive_misses < 3)
            assert (row.title, row.price, row.category) == (old[k]["title"], old[k]["price"], old[k]["category"])


PLAIN = dict(title="t", category="c", price=Decimal("1.00"), currency="USD", stock="in_stock")


def stored_product(url, ext, **more):
    return {**PLAIN, "url": url, "ext": ext, "active": True, "misses": 0, **more}


def landed(*keys):
    return [{**PLAIN, "url": u, "ext": e, "ix": i} for i, (u, e) in enumerate(keys)]


#: stored keys, landed keys, places of new products, number of products afterwards
MATCHES = [
    ([("u1", "e1")], [("u9", "e1")], [], 1),  # moved: the external id finds it
    ([("u1", "e1"), ("u2", "e2")], [("u1", "e2")], [], 2),  # the url goes before the external id
    ([("u1", None)], [("u2", ""), ("u3", None)], [0, 1], 3),  # empty ids match nothing
    ([], [("u1", "e1"), ("u2", "e1"), ("u1", "e2")], [0], 1),  # later items join the product opened in the batch
    ([], [("", "e1"), ("u2", "e1")], [1], 1),  # an item without url is none
    ([], [("u1", "e1"), ("u2", "e1"), ("u2", "e2"), ("u3", "e2"), ("u3", "e3"), ("u4", "e3"), ("u4", None)], [0, 2, 4, 6], 4),
]


def test_matching_by_url_and_external_id(spark):
    """Every case is a shop. In the last one each opener hinges on the one before: an item is matched by the keys that products
    were opened with, so every second item opens one.
    """
    result = run(spark, {c: [stored_product(*k) for k in m[0]] for c, m in enumerate(MATCHES)}, {c: landed(*m[1]) for c, m in enumerate(MATCHES)})
    opened, products = {c: [] for c in range(len(MATCHES))}, Counter(r.competitor_id for r in result.state.select("competitor_id").collect())
    for e in result.events.where("event_type = 'new_product'").orderBy("item_ix").collect():
        opened[e.competitor_id].append(e.item_ix)
    assert [(opened[c], products[c]) for c in range(len(MATCHES))] == [(m[2], m[3]) for m in MATCHES]


def test_empty_scan_is_rejected_unless_allowed(spark):
    base = dict(url="u1", ext=None, title="t", category="c", price=Decimal("1.00"), currency="USD", stock="in_stock", misses=2, active=True)
    state = run(spark, {0: [base], 1: [base], 2: [base]}, {0: []}).state.select(*STATE_COLUMNS)
    state = state.withColumn("consecutive_misses", F.lit(2)).withColumn("active", F.lit(True))
    scans = spark.createDataFrame([(0, False), (1, True)], SCAN_SCHEMA)
    none = spark.createDataFrame([], ITEM_SCHEMA)
    result = detect.apply_scan(state, none, scans, NOW)
    assert {r.competitor_id: r.accepted for r in result.scans.collect()} == {0: False, 1: True}
    assert [r.competitor_id for r in detect.rejected_scans(scans, none).collect()] == [0]
    assert {r.competitor_id: (r.active, r.consecutive_misses) for r in result.state.collect()} == {0: (True, 2), 1: (False, 3), 2: (True, 2)}
    assert [(e.competitor_id, e.event_type) for e in result.events.collect()] == [(1, "product_removed")]


def test_event_texts_and_payloads(spark):
    base = dict(url="u1", ext=None, title="Old", category="a", price=Decimal("10.00"), currency="USD", stock="in_stock", misses=0, active=True)
    item = dict(url="u1", ext="x", title="New", category="", price=Decimal("12.50"), currency="EUR", stock="unknown", ix=0)
    found = {e.event_type: e for e in run(spark, {0: [base]}, {0: [item]}).events.collect()}
    rise, stock = found["price_increase"], found["stock_out"]
    assert rise.event_message == "Price changed for Old: 10.0 -> 12.5"
    assert (rise.new_value.diff_amount, rise.new_value.diff_percentage) == (Decimal("2.50"), Decimal("25.00"))
    assert (rise.old_value.currency, rise.new_value.currency, rise.new_value.category) == ("USD", "EUR", "a")
    assert stock.event_message == "Stock changed for Old: in_stock -> unknown" and stock.old_value.price is None


def test_external_id_alone_is_no_change(spark):
    base = dict(url="u1", ext="e1", title="t", category="a", price=Decimal("1.00"), currency="USD", stock="in_stock", misses=0, active=True)
    result = run(spark, {0: [base]}, {0: [{**base, "ext": "e2", "currency": "EUR", "ix": 0}]})
    assert result.events.count() == 0 and result.snapshots.count() == 0
    assert [(r.external_id, r.currency) for r in result.state.collect()] == [("e2", "USD")]


@pytest.mark.parametrize("column,old,new,kind", [
    ("price", Decimal("50.00"), Decimal("40.00"), "price_decrease"), ("price", Decimal("40.00"), Decimal("50.00"), "price_increase"),
    ("price", None, Decimal("10.00"), "price_changed"), ("price", Decimal("10.00"), None, "price_changed"), ("price", None, None, None),
    ("stock", "out_of_stock", "in_stock", "stock_in"), ("stock", "out_of_stock", "unknown", "stock_out"),
])
def test_change_types(spark, column, old, new, kind):
    base = dict(url="u1", ext=None, title="t", category="a", price=Decimal("1.00"), currency="USD", stock="in_stock", misses=0, active=True)
    result = run(spark, {0: [{**base, column: old}]}, {0: [{**base, column: new, "ix": 0}]})
    assert [e.event_type for e in result.events.collect()] == ([kind] if kind else [])


history_rows = st.lists(
    st.tuples(st.integers(0, 1), st.integers(1, 9), st.integers(0, 2), price, st.sampled_from(["in_stock", "unknown"]), st.sampled_from(["", "c1", "c2"])),
    min_size=1, max_size=40, unique_by=lambda r: r[:3],
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(history_rows)
def test_replay_equals_folded_scans(spark, rows):
    observations = spark.createDataFrame(rows, "competitor_id long, scan_no int, product_key long, price decimal(12,2), stock_status string, category string")
    got = Counter((r.competitor_id, r.product_key, r.scan_no, r.event_type) for r in history.replay_history(observations).collect())
    expected, state = Counter(), spark.createDataFrame([], STATE_SCHEMA)
    for number in range(1, 10):
        scanned = sorted({c for c, n, *_ in rows if n == number})
        landed_rows = [(c, k, f"u{k}", None, "t", p, "USD", s, None, None, cat) for c, n, k, p, s, cat in rows if n == number]
        if not scanned:
            continue
        scans = spark.createDataFrame([(c, False) for c in scanned], SCAN_SCHEMA)
        result = detect.apply_scan(state, spark.createDataFrame(landed_rows, ITEM_SCHEMA), scans, NOW, keep_sequence=True)
        gone = {r.product_id: int(r.url[1:]) for r in result.state.select("product_id", "url").collect()}
        for e in result.events.collect():
            expected[(e.competitor_id, gone[e.product_id] if e.item_ix < 0 else e.item_ix, number, e.event_type)] += 1
        state = spark.createDataFrame(result.state.collect(), result.state.schema)
    assert got == expected
    final = {(r.competitor_id, r.product_key): (r.consecutive_misses, r.active)
             for r in history.missing_products(history.replay_sequence(observations)).collect()}
    assert final == {(r.competitor_id, int(r.url[1:])): (r.consecutive_misses, r.active) for r in state.collect()}
