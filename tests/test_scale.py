"""Queries on tables that the test folders are too small or too regular for, and the plans that large tables need."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwatch.operators import compare as comparing
from shelfwatch.operators import detect, notify, search
from shelfwatch.plans import detection, fixtures
from shelfwatch.plans.registry import Source
from shelfwatch.schemas import ITEM_SCHEMA
from shelfwatch.session import with_distinct
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
JOBS, ORACLE = entry.queries(), entry.oracle_sql()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The test folder twice over, a second copy's parts a million and its suppliers one above the first's."""
    folder = tmp_path_factory.mktemp("copied")
    db = connect(FOLDER)
    shifts = {"part": "p_partkey", "lineitem": "l_partkey"}
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        if table in shifts:
            key = shifts[table]
            other = f"SELECT * REPLACE ({key} + 1000000 AS {key}{', l_suppkey - 1 AS l_suppkey' if table == 'lineitem' else ''}) FROM {table}"
            db.sql(f"COPY (SELECT * FROM {table} UNION ALL {other}) TO '{folder}/{name}' (FORMAT parquet)")
        else:
            os.symlink(f"{FOLDER}/{name}", folder / name)
    return str(folder)


def test_exported_items_are_not_broadcast(spark):
    assert "SortMergeJoin [competitor_id" in plan_of(JOBS["export_rows"](spark, FOLDER))


def test_aliases_of_repeated_ids(spark, copied):
    problem, n = compare(spark, connect(copied), copied, "comparison_aliases", JOBS["comparison_aliases"], ORACLE["comparison_aliases"])
    assert not problem and n > 0, problem


@pytest.mark.parametrize("name", ["apply_scan_state", "new_products", "scan_to_outbox"])
def test_scan_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(detection, "LINES_PER_TASK", 300)
    monkeypatch.setattr(detect, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(notify, "ROWS_PER_RANGE", 300)
    source = Source(spark, FOLDER)
    assert detection.scan_lines(source).rdd.getNumPartitions() == -(-source.table("lineitem").count() // 300)
    sequence = detection.scan(source).sequence
    assert sequence.rdd.getNumPartitions() == -(-sequence.count() // 200)
    problem, _ = compare(spark, connect(FOLDER), FOLDER, name, JOBS[name], ORACLE[name])
    assert not problem, problem


@pytest.mark.parametrize("name", ["apply_scan", "apply_scan_snapshots", "scan_to_dashboard"])
def test_matching_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(detect, "ROWS_PER_TASK", 500)
    dealt, tasks_for = [], detect.tasks_for
    monkeypatch.setattr(detect, "tasks_for", lambda *args: dealt.append(tasks_for(*args)) or dealt[-1])
    frame = JOBS[name](spark, FOLDER)
    problem, _ = compare(spark, connect(FOLDER), FOLDER, name, lambda *_: frame, ORACLE[name])
    assert not problem, problem
    assert len(dealt) >= 5 and dealt[0] > 8  # matching, new products in rounds, their items, the sequence
    assert name == "apply_scan_snapshots" or "REPARTITION_BY_NUM" in plan_of(frame)


def test_items_without_url_spread(spark, monkeypatch):
    monkeypatch.setattr(detect, "ROWS_PER_TASK", 100)
    items = spark.range(2000).selectExpr("1L AS competitor_id", "id AS item_ix", "if(id % 100 = 0, 'u' || id, '') AS url", "cast(null as string) AS external_id")
    state = spark.range(0, 2000, 200).selectExpr("1L AS competitor_id", "'p' || id AS product_id", "'u' || id AS url", "'' AS external_id")
    matched = detect._matched(items, state)
    sizes = [r["count"] for r in matched.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 300 and sum(sizes) == 2000
    assert {(r.url, r.by_url) for r in matched.where("by_url is not null").collect()} == {(f"u{i}", f"p{i}") for i in range(0, 2000, 200)}


def test_dashboard_keeps_what_it_counts(spark, monkeypatch):
    kept, cut = [], detect.cut_lineage
    monkeypatch.setattr(detect, "cut_lineage", lambda rows: kept.append(rows) or cut(rows))
    JOBS["scan_to_dashboard"](spark, FOLDER)
    assert {"price_changed", "is_removed", "is_last", "active"} <= set(kept[-1].columns) and "title" not in kept[-1].columns
    plan = plan_of(kept[-1])
    assert "item_ix" in plan and not any(name in plan for name in ("title#", "category#", "currency#", "first_seen_at#"))


def test_pairs_are_looked_up_once(spark, monkeypatch):
    looked, look_up = [], detect._with_largest
    monkeypatch.setattr(detect, "_with_largest", lambda rows, *args: looked.append(rows.count()) or look_up(rows, *args))
    empty = [F.lit(None).cast("string").alias(c) for c in ("title", "currency", "stock_status", "sku", "image_url", "category")]
    rows = spark.range(2000).selectExpr("1L AS competitor_id", "id AS item_ix", "'u' || id % 20 AS url", "if(id % 40 < 20, '', null) AS external_id", "1.00 AS price")
    items = rows.select("*", *empty)
    state = spark.range(0, 20, 4).selectExpr("1L AS competitor_id", "'p' || id AS product_id", "'u' || id AS url", "'' AS external_id")
    found = detect.assign_products(items, state, "2024-01-01 00:00:00").groupBy("url").agg(F.count("*").alias("n"), F.collect_set("product_id").alias("ids")).collect()
    assert looked == [20, 15]
    assert len(found) == 20 and all(r.n == 100 and len(r.ids) == 1 for r in found)
    assert {r.url: r.ids[0] for r in found if r.ids[0].startswith("p")} == {f"u{i}": f"p{i}" for i in range(0, 20, 4)}


def test_a_product_is_found_from_its_opener_on(spark):
    rows = [(1, "a", "X"), (1, "a", "X"), (2, "b", "X"), (3, "b", None), (4, "b", "X"), (5, "c", "S"), (6, "c", ""), (7, "c", "S"), (8, "s", "X"), (9, "d", "Y"), (9, "d", "Y")]
    items = spark.createDataFrame([(1, ix, url, external, "t", None, None, None, None, None, None) for ix, url, external in rows], ITEM_SCHEMA)
    state = spark.createDataFrame([(1, "p1", "s", "S"), (1, "p2", "s", "S")], "competitor_id long, product_id string, url string, external_id string")
    found = detect.assign_products(items, state, "2024-01-01 00:00:00").collect()
    opened = {u: hashlib.md5(f"1|{u}|2024-01-01 00:00:00".encode()).hexdigest() for u in "abcd"}
    expected = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "p2"), (6, "c"), (7, "c"), (8, "p2"), (9, "d"), (9, "d")]
    assert sorted((r.item_ix, r.product_id) for r in found) == sorted((ix, opened.get(name, name)) for ix, name in expected)


def test_lines_are_dealt_once_their_region_is_known(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(detection.scan_lines(Source(spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = [line for line in plan.splitlines() if "hashpartitioning(l_partkey" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]


def test_messages_are_numbered_before_they_are_rendered(spark, monkeypatch):
    seen, pace = [], notify.paced
    monkeypatch.setattr(notify, "paced", lambda rows, **options: seen.append(rows.columns) or pace(rows, **options))
    assert "send_after" in JOBS["notification_outbox"](spark, FOLDER).columns
    assert seen and "fields" not in seen[0] and "content" not in seen[0]


@pytest.mark.parametrize("name", ["extract_listing_cards", "extract_category_api_json", "dedupe_catalog", "jsonld_products", "extract_html_products", "extract_graphql_json"])
def test_pages_are_dealt_before_they_are_parsed(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "PAGES_PER_TASK", 10)
    frame = JOBS[name](spark, FOLDER)
    if name == "extract_category_api_json":  # its records are written by the tasks that parse them
        assert len(frame.inputFiles()) == 20
    else:
        assert "REPARTITION_BY_NUM" in plan_of(frame)
    problem, _ = compare(spark, connect(FOLDER), FOLDER, name, JOBS[name], ORACLE[name])
    assert not problem, problem


@pytest.mark.parametrize("name, module, step", [
    ("search_suggestions", search, "with_match_scores"), ("suggestion_competitors", search, "with_match_scores"), ("search_products", search, "with_match_scores"),
    ("compare_product", comparing, "with_comparison_score"), ("comparison_head", comparing, "with_comparison_score"),
    ("market_comparison", comparing, "with_identity"), ("market_comparison_fuzzy", comparing, "with_extraction"),
])
def test_titles_are_told_once_each(spark, monkeypatch, name, module, step):
    seen, told = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda rows, *args, **options: seen.append(rows) or told(rows, *args, **options))
    JOBS[name](spark, FOLDER)
    assert seen and all("id" not in rows.columns and rows.count() == rows.distinct().count() for rows in seen)


def test_distinct_values_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, "b", "x"), (5, None, None)], "id int, k string, l string")
    told = with_distinct(rows, ["k", "l"], lambda d: d.where("k is null or k <> 'b'").selectExpr("*", "concat_ws('-', k, l) AS n"))
    assert told.columns == ["id", "k", "l", "n"]
    assert sorted((r.id, r.n) for r in told.collect()) == [(1, "a"), (2, "a"), (3, "x"), (5, "")]


def test_lookup_leaves_lines_out_before_they_are_products(spark, copied):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = JOBS["product_lookup"](spark, copied)._jdf.queryExecution().optimizedPlan().toString()
        problem, n = compare(spark, connect(copied), copied, "product_lookup", JOBS["product_lookup"], ORACLE["product_lookup"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.rindex("LeftSemi") > plan.index("Aggregate [l_suppkey")
    assert not problem and n > 0, problem
