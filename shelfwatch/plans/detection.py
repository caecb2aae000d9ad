"""Change-detection jobs: one scan batch, and the replay of a whole history."""

from pyspark.sql import functions as F

from shelfwatch.operators import detect, history
from shelfwatch.plans.fixtures import oracle
from shelfwatch.plans.registry import job
from shelfwatch.schemas import ITEM_COLUMNS, STATE_COLUMNS
from shelfwatch.session import cut_lineage, tasks_for

NOW = "2002-01-01 00:00:00"

# The lines of a region are its catalog: those before 1998 make the stored state, those since make one scan batch with
# several items per product. Parts divisible by three carry an external id and change their url in every other line.
SCAN_LINES = """
    SELECT n.n_regionkey AS competitor_id, l.l_partkey AS part, p.p_name AS name, l.l_linenumber AS line,
           l.l_orderkey * 10 + l.l_linenumber AS item_ix,
           CAST(min(l.l_extendedprice) AS DECIMAL(12,2)) AS price,
           CASE max(l.l_returnflag) WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS stock_status,
           min(l.l_shipdate) AS shipdate, max(l.l_quantity) AS quantity,
           concat('https://r', CAST(n.n_regionkey AS STRING), '.example.com/products/p', CAST(l.l_partkey AS STRING)) AS page,
           CASE WHEN l.l_partkey % 3 = 0 THEN concat('x', CAST(l.l_partkey AS STRING)) END AS external_id
    FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
                      JOIN {part} p ON l.l_partkey = p.p_partkey
    GROUP BY n.n_regionkey, l.l_partkey, p.p_name, l.l_linenumber, l.l_orderkey"""

PRIOR = """
    SELECT CAST(competitor_id AS BIGINT) AS competitor_id,
           concat('r', CAST(competitor_id AS STRING), '-p', CAST(part AS STRING)) AS product_id,
           page AS url, external_id, name AS title, name AS normalized_title,
           CASE WHEN part % 4 = 0 THEN '' ELSE 'old category' END AS category, CAST(NULL AS STRING) AS image_url,
           max_by(price, item_ix) AS price, 'USD' AS currency, max_by(stock_status, item_ix) AS stock_status,
           CAST(NULL AS STRING) AS sku, min(shipdate) AS first_seen_at, max(shipdate) AS last_seen_at,
           max(shipdate) AS last_checked_at, (max(shipdate) >= TIMESTAMP '1996-07-01') AS active,
           CAST(CASE WHEN max(shipdate) < TIMESTAMP '1996-07-01' THEN 3 WHEN max(shipdate) < TIMESTAMP '1997-01-01' THEN 2
                     WHEN max(shipdate) < TIMESTAMP '1997-07-01' THEN 1 ELSE 0 END AS INT) AS consecutive_misses, part
    FROM {lines} WHERE shipdate < TIMESTAMP '1998-01-01' GROUP BY competitor_id, part, page, external_id, name"""

BATCH = """
    SELECT CAST(competitor_id AS BIGINT) AS competitor_id, item_ix,
           CASE WHEN external_id IS NOT NULL AND line % 2 = 0 THEN concat(page, '-new') ELSE page END AS url, external_id,
           CASE WHEN quantity > 25 THEN concat(name, ' xl') ELSE name END AS title, price,
           CASE WHEN line = 7 THEN 'EUR' ELSE 'USD' END AS currency, stock_status, CAST(NULL AS STRING) AS sku,
           CAST(NULL AS STRING) AS image_url,
           CASE WHEN line % 5 = 0 THEN '' ELSE concat('cat', CAST(line AS STRING)) END AS category, part
    FROM {lines} WHERE shipdate >= TIMESTAMP '1998-01-01'"""

_ORACLE_VIEWS = {
    "lines": SCAN_LINES, "prior": PRIOR.replace("{lines}", "lines"), "batch": BATCH.replace("{lines}", "lines"),
    "unioned": """
        SELECT competitor_id, part, CAST(-1 AS BIGINT) AS item_ix, product_id, url, title, category, price, currency, stock_status,
               first_seen_at, last_seen_at, last_checked_at, consecutive_misses, active FROM prior
        UNION ALL
        SELECT competitor_id, part, item_ix, NULL, url, title, category, price, currency, stock_status,
               TIMESTAMP '2002-01-01', TIMESTAMP '2002-01-01', TIMESTAMP '2002-01-01', 0, true FROM batch""",
    "ordered": """
        SELECT * REPLACE (coalesce(first_value(product_id) OVER o,
                            md5(concat(CAST(competitor_id AS VARCHAR), '|', first_value(url) OVER o, '|2002-01-01 00:00:00')))
                            AS product_id,
                          first_value(first_seen_at) OVER o AS first_seen_at),
               row_number() OVER o AS rn, lead(item_ix) OVER o IS NULL AS is_last,
               coalesce(last_value(nullif(category, '') IGNORE NULLS) OVER o, first_value(category) OVER o) AS carried,
               lag(price) OVER o AS old_price, lag(stock_status) OVER o AS old_stock, lag(title) OVER o AS old_title,
               lag(url) OVER o AS old_url
        FROM unioned WINDOW o AS (PARTITION BY competitor_id, part ORDER BY item_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "seq": """
        SELECT *, lag(carried) OVER o AS old_carried, lag(held) OVER o AS old_held FROM (
          SELECT *, last_value(CASE WHEN rn = 1 OR price <> old_price THEN currency END IGNORE NULLS) OVER o AS held FROM ordered
          WINDOW o AS (PARTITION BY competitor_id, part ORDER BY item_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
        WINDOW o AS (PARTITION BY competitor_id, part ORDER BY item_ix)""",
}


def scan_oracle(body: str) -> str:
    return oracle(body, **_ORACLE_VIEWS)


#: Rows of lineitem that one task aggregates.
LINES_PER_TASK = 250_000


def scan_lines(s):
    """SCAN_LINES with lines and parts dealt by part to tasks of a bounded number of rows, where they are joined and aggregated.

    Left to itself a task would aggregate what one split of the compressed file holds, millions of rows, beside a broadcast part table. Lines are
    dealt when their region is known: where suppliers are too many to be broadcast, lines are shuffled for them before, not out of their tasks and back.
    """
    lines = s.table("lineitem")
    tasks = tasks_for(lines, LINES_PER_TASK)
    text = SCAN_LINES.replace("SELECT", "SELECT /*+ MERGE(p) */", 1).replace("n.n_regionkey", "l.n_regionkey")
    joined = text[text.index("{lineitem} l"):text.index("JOIN {part}")]
    text = text.replace(joined, f"(SELECT /*+ REPARTITION({tasks}, l_partkey) */ l.*, n.n_regionkey FROM {joined}) l ")
    return s.sql(text.replace("{part}", f"(SELECT /*+ REPARTITION({tasks}, p_partkey) */ * FROM {{part}})"))


def scan_inputs(s):
    lines = scan_lines(s)
    state = cut_lineage(s.spark.sql(PRIOR, lines=lines).select(*STATE_COLUMNS))
    items = s.spark.sql(BATCH, lines=lines).select(*ITEM_COLUMNS)
    scans = s.table("region").select(F.col("r_regionkey").cast("long").alias("competitor_id"), F.lit(False).alias("allow_empty"))
    return state, items, scans


def scan(s, keep_sequence=False, reads=None):
    return detect.apply_scan(*scan_inputs(s), NOW, keep_sequence, reads=reads)


@job("match_catalog", scan_oracle("""
    SELECT b.competitor_id, b.item_ix, b.url, coalesce(u.product_id, x.product_id) AS product_id
    FROM batch b LEFT JOIN prior u ON b.competitor_id = u.competitor_id AND b.url = u.url
         LEFT JOIN prior x ON b.competitor_id = x.competitor_id AND b.external_id = x.external_id"""))
def match_catalog(s):
    state, items, _ = scan_inputs(s)
    return detect.match_catalog(items, state).select(
        "competitor_id", "item_ix", "url", F.coalesce("by_url", "by_external").alias("product_id")
    )


PCT = """CAST((CASE WHEN price < old_price THEN -1 ELSE 1 END)
    * ((abs(CAST((price - old_price) * 100 AS BIGINT)) * 20000 + CAST(old_price * 100 AS BIGINT))
       // (2 * CAST(old_price * 100 AS BIGINT))) / 100 AS DECIMAL(18,2))"""


def _num(column):
    return f"regexp_replace(CAST({column} AS VARCHAR), '0$', '')"


EVENTS = f"""
    SELECT competitor_id, product_id, item_ix, 'new_product' AS event_type, CAST(NULL AS DECIMAL(12,2)) AS old_price,
           nullif(price, 0) AS new_price, CAST(NULL AS DECIMAL(18,2)) AS diff_percentage, NULL AS old_category,
           category AS new_category, NULL AS old_currency, currency AS new_currency,
           concat('New product found: ', title) AS event_message
    FROM seq WHERE rn = 1 AND item_ix >= 0
    UNION ALL
    SELECT competitor_id, product_id, item_ix, CASE WHEN price > old_price THEN 'price_increase' ELSE 'price_decrease' END,
           old_price, price, {PCT}, old_carried, carried, old_held, currency,
           concat('Price changed for ', old_title, ': ', {_num('old_price')}, ' -> ', {_num('price')})
    FROM seq WHERE rn > 1 AND price <> old_price
    UNION ALL
    SELECT competitor_id, product_id, item_ix, CASE stock_status WHEN 'in_stock' THEN 'stock_in' ELSE 'stock_out' END,
           NULL, NULL, NULL, old_carried, carried, NULL, NULL,
           concat('Stock changed for ', old_title, ': ', old_stock, ' -> ', stock_status)
    FROM seq WHERE rn > 1 AND stock_status <> old_stock
    UNION ALL
    SELECT competitor_id, product_id, item_ix, 'product_removed', NULL, NULL, NULL, category, NULL, NULL, NULL,
           concat('Product no longer seen: ', title)
    FROM seq WHERE item_ix < 0 AND is_last AND active AND consecutive_misses + 1 >= 3"""


@job("apply_scan", scan_oracle(EVENTS))
def apply_scan(s):
    return scan(s).events.select(
        "competitor_id", "product_id", "item_ix", "event_type", F.col("old_value.price").alias("old_price"),
        F.col("new_value.price").alias("new_price"), F.col("new_value.diff_percentage").alias("diff_percentage"),
        F.col("old_value.category").alias("old_category"), F.col("new_value.category").alias("new_category"),
        F.col("old_value.currency").alias("old_currency"), F.col("new_value.currency").alias("new_currency"), "event_message",
    )


@job("apply_scan_state", scan_oracle("""
    SELECT competitor_id, product_id, url, title, carried AS category, price, held AS currency, stock_status, first_seen_at,
           last_seen_at,
           CASE WHEN item_ix < 0 AND active THEN TIMESTAMP '2002-01-01' ELSE last_checked_at END AS last_checked_at,
           CASE WHEN item_ix < 0 AND active THEN consecutive_misses + 1 ELSE consecutive_misses END AS consecutive_misses,
           CASE WHEN item_ix < 0 THEN active AND consecutive_misses + 1 < 3 ELSE true END AS active
    FROM seq WHERE is_last"""))
def apply_scan_state(s):
    return scan(s).state.select(
        "competitor_id", "product_id", "url", "title", "category", "price", "currency", "stock_status", "first_seen_at",
        "last_seen_at", "last_checked_at", "consecutive_misses", "active",
    )


@job("apply_scan_snapshots", scan_oracle("""
    SELECT competitor_id, product_id, item_ix, title, carried AS category, price, held AS currency, stock_status
    FROM seq WHERE item_ix >= 0 AND (rn = 1 OR price <> old_price OR stock_status <> old_stock OR title <> old_title
                                     OR url <> old_url OR carried IS DISTINCT FROM old_carried)"""))
def apply_scan_snapshots(s):
    return scan(s).snapshots.select(
        "competitor_id", "product_id", "item_ix", "title", "category", "price", "currency", "stock_status"
    )


@job("new_products", scan_oracle("""
    SELECT competitor_id, product_id, url, title, price FROM seq WHERE rn = 1 AND item_ix >= 0"""))
def new_products(s):
    return scan(s).sequence.where("is_new").select("competitor_id", "product_id", "url", "title", "price")


@job("scan_summary", scan_oracle("""
    SELECT competitor_id, count(*) FILTER (WHERE rn = 1 AND item_ix >= 0) AS new_products,
           count(*) FILTER (WHERE rn > 1 AND price <> old_price) AS price_changes FROM seq GROUP BY competitor_id"""))
def scan_summary(s):
    return detect.scan_summary(scan(s).sequence)


# Customers as scanned shops: a scan delivers their finished orders, and those without any delivered nothing.
@job("rejected_scans", """
    SELECT c_custkey AS competitor_id FROM customer
    WHERE c_custkey % 10 <> 7 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def rejected_scans(s):
    items = s.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("competitor_id"))
    scans = s.table("customer").select(F.col("c_custkey").alias("competitor_id"), (F.col("c_custkey") % 10 == 7).alias("allow_empty"))
    return detect.rejected_scans(scans, items)


def _runs(s):
    result = scan(s)
    errors = s.table("region").where("r_regionkey % 2 = 0").select(
        F.col("r_regionkey").cast("long").alias("competitor_id"), F.repeat(F.lit("timeout "), 200).alias("error")
    )
    return detect.scan_runs(result.scans, detect.scan_summary(result.sequence), errors, NOW)


@job("scan_runs", scan_oracle("""
    SELECT r.r_regionkey::BIGINT AS competitor_id, CASE WHEN r.r_regionkey % 2 = 0 THEN 'failed' ELSE 'success' END AS status,
           CASE WHEN r.r_regionkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM batch b WHERE b.competitor_id = r.r_regionkey) END AS products_found,
           CASE WHEN r.r_regionkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM seq q WHERE q.competitor_id = r.r_regionkey AND rn = 1
                AND item_ix >= 0) END AS new_products_count,
           CASE WHEN r.r_regionkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM seq q WHERE q.competitor_id = r.r_regionkey AND rn > 1
                AND price <> old_price) END AS price_changes_count,
           CASE WHEN r.r_regionkey % 2 = 0 THEN repeat('timeout ', 200) END AS error_message
    FROM region r"""))
def scan_runs(s):
    return _runs(s).drop("finished_at")


@job("failure_events", """
    SELECT r_regionkey::BIGINT AS competitor_id, 'scrape_failed' AS event_type,
           repeat('timeout ', 200) AS event_message FROM region WHERE r_regionkey % 2 = 0""")
def failure_events(s):
    return detect.failure_events(_runs(s)).drop("detected_at")


# --- history -----------------------------------------------------------------------------------------------

REPLAY = {
    "calendar": """
        SELECT competitor_id, scan_no, row_number() OVER (PARTITION BY competitor_id ORDER BY scan_no) AS s,
               count(*) OVER (PARTITION BY competitor_id) AS last_s
        FROM (SELECT DISTINCT competitor_id, scan_no FROM observations) d""",
    "seq": """
        SELECT *, lag(carried) OVER (PARTITION BY competitor_id, product_key ORDER BY scan_no) AS old_carried FROM (
          SELECT o.*, c.s, c.last_s, row_number() OVER w AS rn, lag(price) OVER w AS old_price,
                 lag(stock_status) OVER w AS old_stock, lag(c.s) OVER w AS previous_s, lead(c.s) OVER w AS next_s,
                 coalesce(last_value(nullif(category, '') IGNORE NULLS) OVER w, first_value(category) OVER w) AS carried
          FROM observations o JOIN calendar c USING (competitor_id, scan_no)
          WINDOW w AS (PARTITION BY o.competitor_id, product_key ORDER BY o.scan_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t""",
    "removals": """
        SELECT q.competitor_id, q.product_key, c.scan_no, q.scan_no AS last_seen_scan
        FROM seq q JOIN calendar c ON q.competitor_id = c.competitor_id AND c.s = q.s + 3
        WHERE q.next_s IS NULL OR q.next_s > q.s + 3""",
}


def replay_oracle(body):
    return oracle(body, "observations", **REPLAY)


PRICE_TYPE = "CASE WHEN price > old_price THEN 'price_increase' ELSE 'price_decrease' END"
STOCK_TYPE = "CASE WHEN stock_status = 'in_stock' THEN 'stock_in' ELSE 'stock_out' END"


@job("replay_history", replay_oracle(f"""
    SELECT competitor_id, product_key, scan_no, 'new_product' AS event_type FROM seq WHERE rn = 1
    UNION ALL SELECT competitor_id, product_key, scan_no, {PRICE_TYPE} FROM seq WHERE rn > 1 AND price <> old_price
    UNION ALL SELECT competitor_id, product_key, scan_no, {STOCK_TYPE} FROM seq WHERE rn > 1 AND stock_status <> old_stock
    UNION ALL SELECT competitor_id, product_key, scan_no, 'product_removed' FROM removals"""))
def replay_history(s):
    return history.replay_history(s.observations)


@job("price_changes", replay_oracle(f"""
    SELECT competitor_id, product_key, scan_no, {PRICE_TYPE} AS event_type, old_price, price,
           CAST(price - old_price AS DECIMAL(12,2)) AS diff_amount, {PCT} AS diff_percentage
    FROM seq WHERE rn > 1 AND price <> old_price"""))
def price_changes(s):
    return history.price_changes(history.replay_sequence(s.observations))


@job("stock_changes", replay_oracle(f"""
    SELECT competitor_id, product_key, scan_no, {STOCK_TYPE} AS event_type, old_stock, stock_status
    FROM seq WHERE rn > 1 AND stock_status <> old_stock"""))
def stock_changes(s):
    return history.stock_changes(history.replay_sequence(s.observations))


@job("category_carry", replay_oracle("SELECT competitor_id, product_key, scan_no, carried AS category FROM seq"))
def category_carry(s):
    return history.category_carry(history.replay_sequence(s.observations))


@job("snapshot_rows", replay_oracle("""
    SELECT competitor_id, product_key, scan_no, price, stock_status, carried AS category FROM seq
    WHERE rn = 1 OR price <> old_price OR stock_status <> old_stock OR carried IS DISTINCT FROM old_carried"""))
def snapshot_rows(s):
    return history.snapshot_rows(history.replay_sequence(s.observations))


@job("missing_products", replay_oracle("""
    SELECT competitor_id, product_key, CAST(least(last_s - s, 3) AS INT) AS consecutive_misses, last_s - s < 3 AS active
    FROM seq WHERE next_s IS NULL"""))
def missing_products(s):
    return history.missing_products(history.replay_sequence(s.observations))


@job("removed_products", replay_oracle("SELECT * FROM removals"))
def removed_products(s):
    observations = s.observations
    return history.removed_products(history.replay_sequence(observations), history.scan_calendar(observations))


@job("reactivated_products", replay_oracle("SELECT competitor_id, product_key, scan_no FROM seq WHERE s - previous_s > 3"))
def reactivated_products(s):
    return history.reactivated_products(history.replay_sequence(s.observations))


@job("first_seen_products", replay_oracle("""
    SELECT competitor_id, product_key, scan_no, price, stock_status, carried AS category FROM seq WHERE rn = 1"""))
def first_seen_products(s):
    return history.new_products(history.replay_sequence(s.observations))
