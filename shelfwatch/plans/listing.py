"""List-endpoint jobs over the test tables."""

from pyspark.sql import functions as F

from shelfwatch.operators import listing as q
from shelfwatch.plans.fixtures import oracle
from shelfwatch.plans.registry import job
from shelfwatch.plans.reporting import EVENT_COLUMNS, EVENT_JOINS
from shelfwatch.sources.tables import list_competitors, with_competitor

PRODUCT = """p.id, p.competitor_id, c.name AS competitor_name, p.title, p.category, p.current_price, p.currency,
    p.stock_status, p.first_seen_at, p.last_checked_at, p.active"""
PRODUCT_COLUMNS = [
    "id", "competitor_id", "competitor_name", "title", "category", "current_price", "currency", "stock_status",
    "first_seen_at", "last_checked_at", "active",
]
JOINED = "products p JOIN competitors c ON p.competitor_id = c.id"
# Every observation serves as a snapshot: quarters become dates.
SNAPSHOTS = """
    SELECT CAST(competitor_id AS BIGINT) * 1000000000 + product_key AS product_id, price, stock_status,
           make_date(CAST(1995 + (scan_no - 1) // 4 AS INT), CAST(((scan_no - 1) % 4) * 3 + 1 AS INT), 1) AS checked_at
    FROM observations"""


def snapshots(s):
    scan = F.col("scan_no") - 1
    return s.observations.select(
        (F.col("competitor_id").cast("long") * 1000000000 + F.col("product_key")).alias("product_id"), "price", "stock_status",
        F.make_date(1995 + F.floor(scan / 4).cast("int"), (scan % 4 * 3 + 1).cast("int"), F.lit(1)).alias("checked_at"),
    )


@job("list_competitors", oracle("""
    SELECT id, name, base_url, category, active, scan_frequency_minutes, last_scan_status FROM competitors""",
    "competitors"))
def competitors(s):
    return list_competitors(s.competitors).drop("webhook_url")


@job("active_competitors", oracle("SELECT id, name, base_url FROM competitors WHERE active", "competitors"))
def active_competitors(s):
    return list_competitors(s.competitors, active_only=True).select("id", "name", "base_url")


@job("product_list", oracle(f"""
    SELECT {PRODUCT} FROM {JOINED}
    WHERE p.active AND p.stock_status = 'in_stock' AND p.current_price >= 2000 AND p.current_price <= 60000
      AND p.first_seen_at >= TIMESTAMP '1996-01-01' AND p.first_seen_at <= TIMESTAMP '2001-01-01'
      AND contains(p.normalized_title, 'e')""", "products", "competitors"))
def product_list(s):
    return q.product_list(
        s.products, s.competitors, active=True, stock_status="in_stock", min_price=2000, max_price=60000,
        date_from="1996-01-01 00:00:00", date_to="2001-01-01 00:00:00", search="E",
    ).select(*PRODUCT_COLUMNS)


@job("product_list_all", oracle(f"SELECT {PRODUCT} FROM {JOINED}", "products", "competitors"))
def product_list_all(s):
    return q.product_list(s.products, s.competitors).select(*PRODUCT_COLUMNS)


SORTS = {
    "last_checked_at": "p.last_checked_at DESC NULLS FIRST", "price_asc": "p.current_price ASC NULLS LAST",
    "price_desc": "p.current_price DESC NULLS FIRST", "first_seen": "p.first_seen_at DESC NULLS FIRST",
    "title": "p.title ASC NULLS LAST",
}


@job("product_sorts", oracle("\nUNION ALL\n".join(f"""
    SELECT * FROM (SELECT '{name}' AS sort, {PRODUCT}, row_number() OVER (ORDER BY {order}, p.id) AS pos
    FROM {JOINED}) t WHERE pos <= 50""" for name, order in SORTS.items()), "products", "competitors"))
def product_sorts(s):
    rows = q.product_list(s.products, s.competitors).select(*PRODUCT_COLUMNS)
    pages = [q.product_page(rows, name).withColumn("sort", F.lit(name)) for name in SORTS]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


@job("product_page", oracle(f"""
    SELECT {PRODUCT}, row_number() OVER (ORDER BY p.current_price ASC NULLS LAST, p.id) AS pos FROM {JOINED}
    QUALIFY pos > 100 AND pos <= 150""", "products", "competitors"))
def product_page(s):
    return q.product_page(q.product_list(s.products, s.competitors).select(*PRODUCT_COLUMNS), "price_asc", page=3)


@job("product_page_after", oracle(f"""
    SELECT {PRODUCT} FROM {JOINED} QUALIFY row_number() OVER (ORDER BY p.current_price ASC NULLS LAST, p.id) BETWEEN 101 AND 150""", "products", "competitors"))
def product_page_after(s):
    rows = q.product_list(s.products, s.competitors).select(*PRODUCT_COLUMNS)
    last = q.product_page(rows, "price_asc", page=2).orderBy(F.desc("pos")).first().asDict()
    return q.product_page_after(rows, last, "price_asc")


@job("product_total", oracle(f"SELECT count(*) AS total FROM {JOINED}", "products", "competitors"))
def product_total(s):
    return q.total(q.product_list(s.products, s.competitors))


@job("event_list", oracle(f"""
    SELECT {EVENT_COLUMNS} FROM {EVENT_JOINS}
    WHERE NOT e.notification_sent AND e.detected_at >= TIMESTAMP '2024-01-05' AND e.detected_at <= TIMESTAMP '2024-01-25'""",
    "market_events", "competitors", "market_products"))
def event_list(s):
    return q.event_list(
        s.market_events, s.competitors, s.market_products, notification_sent=False,
        date_from="2024-01-05 00:00:00", date_to="2024-01-25 00:00:00",
    )


@job("event_list_by_category", oracle(f"""
    SELECT {EVENT_COLUMNS} FROM {EVENT_JOINS} WHERE p.category = 'group 3' AND e.event_type = 'price_decrease'""",
    "market_events", "competitors", "market_products"))
def event_list_by_category(s):
    return q.event_list(
        s.market_events, s.competitors, s.market_products, category="group 3", event_type="price_decrease"
    )


PAYLOADS = """
    SELECT e.*, CASE WHEN e.id % 2 = 0 THEN concat('new ', CAST(e.id % 5 AS STRING)) WHEN e.id % 3 = 0 THEN '' END AS new_category,
           CASE WHEN e.id % 5 = 0 THEN concat('old ', CAST(e.id % 4 AS STRING)) END AS old_category
    FROM market_events e"""


@job("event_category", oracle("""
    SELECT e.id, coalesce(nullif(e.new_category, ''), nullif(e.old_category, ''), nullif(p.category, '')) AS product_category
    FROM payloads e JOIN competitors c ON e.competitor_id = c.id LEFT JOIN market_products p ON e.product_id = p.id""",
    "market_events", "competitors", "market_products", payloads=PAYLOADS))
def event_category(s):
    i = F.col("id")
    text = lambda prefix, n: F.concat(F.lit(prefix), (i % n).cast("string"))
    rows = s.market_events.withColumns({
        "new_category": F.when(i % 2 == 0, text("new ", 5)).when(i % 3 == 0, ""),
        "old_category": F.when(i % 5 == 0, text("old ", 4)),
    })
    listed = q.event_list(rows, s.competitors, s.market_products, keep=("new_category", "old_category"))
    shown = q.event_category(F.col("new_category"), F.col("old_category"), F.col("product_category"))
    return listed.select("id", shown.alias("product_category"))


@job("product_lookup", oracle(f"""
    SELECT {PRODUCT} FROM {JOINED} WHERE p.id IN (SELECT l_suppkey * 1000000 + l_partkey FROM lineitem WHERE l_quantity >= 49)""",
    "products", "competitors"))
def product_lookup(s):
    lines = s.table("lineitem").withColumn("id", F.expr("l_suppkey * 1000000 + l_partkey"))
    wanted = lines.where("l_quantity >= 49").select("id").distinct()
    # a product's lines all have its id: lines of products that nobody asked for are left out before names are joined to them and they are grouped
    products = s.view_of("products", lineitem=lines.join(wanted, "id", "left_semi").drop("id"))
    return q.product_lookup(products, s.competitors, wanted).select(*PRODUCT_COLUMNS)


@job("product_history", oracle("SELECT * FROM snapshots", "observations", snapshots=SNAPSHOTS))
def product_history(s):
    return q.product_history(snapshots(s))


@job("price_extremes", oracle("""
    SELECT product_id, count(*) AS n_snapshots, min(nullif(price, 0)) AS low, max(nullif(price, 0)) AS high
    FROM snapshots GROUP BY product_id HAVING count(*) >= 2""", "observations", snapshots=SNAPSHOTS))
def price_extremes(s):
    return q.price_extremes(snapshots(s))


@job("price_series", oracle("""
    SELECT product_id, CAST(checked_at AS DATE) AS day, price FROM snapshots WHERE price <> 0
    QUALIFY count(*) OVER (PARTITION BY product_id) >= 2""", "observations", snapshots=SNAPSHOTS))
def price_series(s):
    return q.price_series(snapshots(s)).select("product_id", "day", "price")


@job("activity_by_day", oracle("""
    SELECT CAST(detected_at AS DATE) AS day, count(*) AS n_events FROM market_events GROUP BY 1""", "market_events"))
def activity_by_day(s):
    return q.activity_by_day(s.market_events)


@job("product_events", oracle("""
    SELECT e.product_id, e.id, e.event_type, e.detected_at FROM market_events e
    WHERE e.product_id IN (SELECT id FROM market_products WHERE current_price >= 90)""", "market_events", "market_products"))
def product_events(s):
    wanted = s.market_products.where("current_price >= 90").select(F.col("id").alias("product_id"))
    return q.product_events(s.market_events, wanted).select("product_id", "id", "event_type", "detected_at")


@job("products_with_competitor", oracle(
    "SELECT p.id, c.name AS competitor_name FROM products p JOIN competitors c ON p.competitor_id = c.id",
    "products", "competitors"))
def products_with_competitor(s):
    return with_competitor(s.products, s.competitors).select("id", "competitor_name")
