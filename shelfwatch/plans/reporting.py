"""Dashboard and sales-signal jobs over the test tables."""

from pyspark.sql import functions as F

from shelfwatch.operators import dashboard as d
from shelfwatch.plans.fixtures import NOW, oracle
from shelfwatch.plans.registry import job
from shelfwatch.streaming import scans as streams

TS = f"TIMESTAMP '{NOW}'"
# The counters look at the calendar day of `now`; the busiest hour of the test data lies on its last full day.
TODAY = "2024-01-30 15:30:00"
MIDNIGHT = "TIMESTAMP '2024-01-30 00:00:00'"
WEEK = "TIMESTAMP '2024-01-24 00:00:00'"
MONTH = "TIMESTAMP '2024-01-01 00:00:00'"

SIGNALS = """
    SELECT competitor_id,
           count(*) FILTER (WHERE event_type = 'stock_out') AS inferred_sold_count,
           count(*) FILTER (WHERE event_type = 'product_removed') AS removed_count,
           count(DISTINCT CASE WHEN event_type = 'stock_out' THEN product_id END) AS unique_products_count,
           max(CASE WHEN event_type = 'stock_out' THEN detected_at END) AS last_signal_at
    FROM market_events WHERE detected_at >= {start} GROUP BY competitor_id"""

TRENDS = """
    SELECT c.id AS competitor_id, c.name AS competitor_name, coalesce(s.inferred_sold_count, 0) AS inferred_sold_count,
           coalesce(s.removed_count, 0) AS removed_count, coalesce(s.unique_products_count, 0) AS unique_products_count,
           s.last_signal_at
    FROM competitors c LEFT JOIN (""" + SIGNALS.format(start=WEEK) + """) s ON s.competitor_id = c.id WHERE c.active"""

EVENT_COLUMNS = """e.id, e.competitor_id, c.name AS competitor_name, e.product_id, p.title AS product_title,
    p.category AS product_category, e.event_type, e.detected_at, e.notification_sent"""
EVENT_JOINS = """market_events e JOIN competitors c ON e.competitor_id = c.id
    LEFT JOIN market_products p ON e.product_id = p.id"""


@job("sales_trends", oracle(TRENDS, "competitors", "market_events"))
def sales_trends(s):
    return d.sales_trends(s.market_events, s.competitors, NOW, "week")


@job("sales_trends_rolled", oracle(TRENDS, "competitors", "market_events"))
def sales_trends_rolled(s):
    signals = d.rolled_signals(d.daily_rollup(s.market_events), s.market_events, d.period_start(NOW, "week"))
    return d.trends_of(signals, s.competitors)


@job("dashboard_counters", oracle(f"""
    SELECT count(*) FILTER (WHERE event_type = 'new_product') AS new_products_today,
           count(*) FILTER (WHERE event_type IN ('price_increase', 'price_decrease', 'price_changed')) AS price_changes_today,
           count(*) FILTER (WHERE event_type = 'price_decrease') AS price_drops_today,
           count(*) FILTER (WHERE event_type = 'price_increase') AS price_increases_today
    FROM market_events WHERE detected_at >= {MIDNIGHT}""", "market_events"))
def dashboard_counters(s):
    return d.dashboard_counters(s.market_events, TODAY)


@job("failed_scans", oracle(f"""
    SELECT count(*) AS failed_scans_today FROM market_runs WHERE status = 'failed' AND started_at >= {MIDNIGHT}""",
    "market_runs"))
def failed_scans(s):
    return d.failed_scans(s.market_runs, TODAY)


@job("latest_events", oracle(f"""
    SELECT {EVENT_COLUMNS}, row_number() OVER (ORDER BY e.detected_at DESC NULLS FIRST, e.id DESC) AS pos
    FROM {EVENT_JOINS} QUALIFY pos <= 20""", "market_events", "competitors", "market_products"))
def latest_events(s):
    return d.latest_events(s.market_events, s.competitors, s.market_products)


@job("attention_competitors", oracle("""
    SELECT id, name, base_url, category FROM competitors WHERE active AND last_scan_status = 'failed'""", "competitors"))
def attention_competitors(s):
    return d.attention_competitors(s.competitors).select("id", "name", "base_url", "category")


@job("sales_by_competitor", oracle(f"""
    SELECT c.id AS competitor_id, c.name AS competitor_name, count(*) AS inferred_sold_count,
           count(DISTINCT e.product_id) AS unique_products_count, max(e.detected_at) AS last_signal_at
    FROM market_events e JOIN competitors c ON e.competitor_id = c.id
    WHERE e.event_type = 'stock_out' AND e.detected_at >= {MONTH} GROUP BY c.id, c.name""",
    "market_events", "competitors"))
def sales_by_competitor(s):
    return d.sales_by_competitor(s.market_events, s.competitors, NOW, "month")


@job("removals_by_competitor", oracle(f"""
    SELECT competitor_id, count(*) AS removed_count FROM market_events
    WHERE event_type = 'product_removed' AND detected_at >= {MONTH} GROUP BY competitor_id""", "market_events"))
def removals_by_competitor(s):
    signals = d.competitor_signals(s.market_events, d.period_start(NOW, "month"))
    return signals.where("removed_count > 0").select("competitor_id", "removed_count")


@job("top_stockout_products", oracle(f"""
    SELECT p.id AS product_id, p.title, p.category, p.url, p.image_url, p.current_price, p.currency, p.stock_status,
           p.competitor_id, c.name AS competitor_name, count(*) AS inferred_sold_count,
           max(e.detected_at) AS last_signal_at,
           row_number() OVER (ORDER BY count(*) DESC, max(e.detected_at) DESC, p.title, p.id) AS pos
    FROM market_events e JOIN market_products p ON e.product_id = p.id JOIN competitors c ON p.competitor_id = c.id
    WHERE e.event_type = 'stock_out' AND e.detected_at >= {MONTH}
    GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 ORDER BY pos LIMIT 25""",
    "market_events", "market_products", "competitors"))
def top_stockout_products(s):
    return d.top_stockout_products(s.market_events, s.market_products, s.competitors, NOW, "month")


@job("sales_totals", oracle(f"""
    SELECT CAST(sum(inferred_sold_count) AS BIGINT) AS total_inferred_sold, CAST(sum(removed_count) AS BIGINT) AS total_removed,
           count(*) FILTER (WHERE inferred_sold_count > 0) AS sites_with_signals,
           (SELECT competitor_name FROM ({TRENDS}) x WHERE inferred_sold_count > 0
            ORDER BY inferred_sold_count DESC, competitor_name LIMIT 1) AS top_site
    FROM ({TRENDS}) t""", "competitors", "market_events"))
def sales_totals(s):
    return d.sales_totals(d.sales_trends(s.market_events, s.competitors, NOW, "week"))


DAILY = f"""
    SELECT (SELECT count(*) FROM market_events WHERE event_type = 'new_product' AND detected_at >= {MIDNIGHT})
               AS new_products_today,
           (SELECT count(*) FROM market_events WHERE event_type IN ('price_increase', 'price_decrease')
                AND detected_at >= {MIDNIGHT}) AS price_changes_today,
           (SELECT count(*) FROM market_runs WHERE status = 'failed' AND started_at >= {MIDNIGHT}) AS failed_scans,
           (SELECT count(DISTINCT competitor_id) FROM market_runs WHERE started_at >= {MIDNIGHT}) AS competitors_scanned"""


@job("daily_summary", oracle(DAILY, "market_events", "market_runs"))
def daily_summary(s):
    return d.daily_summary(s.market_events, s.market_runs, TODAY)


@job("biggest_drops", oracle(f"""
    SELECT id, product_id, old_price, new_price, diff_amount, row_number() OVER (ORDER BY diff_amount, id) AS pos
    FROM (SELECT id, product_id, CAST(100 AS DECIMAL(12,2)) AS old_price, CAST(value AS DECIMAL(12,2)) AS new_price,
                 CAST(value AS DECIMAL(12,2)) - CAST(100 AS DECIMAL(12,2)) AS diff_amount
          FROM market_events WHERE event_type = 'price_decrease' AND detected_at >= {MIDNIGHT}) t
    QUALIFY pos <= 5""", "market_events"))
def biggest_drops(s):
    priced = s.market_events.select(
        "id", "product_id", "event_type", "detected_at",
        F.lit(100).cast("decimal(12,2)").alias("old_price"), F.col("value").cast("decimal(12,2)").alias("new_price"),
    )
    return d.biggest_drops(priced, TODAY).select("id", "product_id", "old_price", "new_price", "diff_amount", "pos")


@job("events_by_window", oracle("""
    SELECT date_trunc('hour', detected_at) AS window_start, event_type, count(*) AS n
    FROM market_events GROUP BY 1, 2""", "market_events"))
def events_by_window(s):
    out = d.events_by_window(s.market_events)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@job("windowed_sales", oracle("""
    SELECT date_trunc('day', detected_at)::TIMESTAMP AS window_start, competitor_id, count(*) AS inferred_sold_count, count(DISTINCT product_id) AS unique_products_count,
           max(detected_at) AS last_signal_at
    FROM market_events WHERE event_type = 'stock_out' GROUP BY 1, 2""", "market_events"))
def windowed_sales(s):
    out = streams.windowed_sales(s.market_events)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "last_signal_at")})
