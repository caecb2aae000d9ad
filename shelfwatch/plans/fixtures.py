"""Catalog-shaped views over the generic test tables.

Each view is written once, in SQL that Spark and DuckDB both run, with `{table}` placeholders. Spark reads the parquet
files through them; the oracle inlines them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.session import tasks_for
from shelfwatch.sources.tables import table

NOW = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {
    "competitors": """
        SELECT s.s_suppkey AS id, s.s_name AS name,
               concat('https://s', CAST(s.s_suppkey AS STRING), '.example.com') AS base_url,
               n.n_name AS category, (s.s_suppkey % 10 <> 7) AS active, 60 AS scan_frequency_minutes,
               CASE WHEN s.s_acctbal < 0 THEN 'failed' ELSE 'success' END AS last_scan_status,
               CASE WHEN s.s_suppkey % 3 = 0 THEN concat('https://hooks.example.com/', n.n_name) END AS webhook_url
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    "products": """
        SELECT l.l_suppkey * 1000000 + l.l_partkey AS id, l.l_suppkey AS competitor_id,
               p.p_name AS title, p.p_name AS normalized_title, p.p_type AS category,
               CASE WHEN min(l.l_extendedprice) < 1500 THEN NULL
                    ELSE CAST(min(l.l_extendedprice) AS DECIMAL(12,2)) END AS current_price,
               'USD' AS currency,
               CASE max(l.l_returnflag) WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END
                   AS stock_status,
               min(l.l_shipdate) AS first_seen_at, max(l.l_shipdate) AS last_checked_at,
               (max(l.l_linestatus) = 'O') AS active
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        GROUP BY l.l_suppkey, l.l_partkey, p.p_name, p.p_type""",
    "observations": """
        SELECT competitor_id, scan_no, product_key, price, stock_status, category FROM (
          SELECT n.n_regionkey AS competitor_id, l.l_partkey AS product_key,
                 (year(l.l_shipdate) - 1995) * 4 + quarter(l.l_shipdate) AS scan_no,
                 CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price,
                 CASE l.l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END
                     AS stock_status,
                 CASE WHEN l.l_linenumber % 5 = 0 THEN '' ELSE concat('cat', CAST(l.l_linenumber AS STRING)) END
                     AS category,
                 row_number() OVER (PARTITION BY n.n_regionkey, l.l_partkey,
                     (year(l.l_shipdate) - 1995) * 4 + quarter(l.l_shipdate)
                   ORDER BY l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice, l.l_quantity,
                            l.l_returnflag) AS rn
          FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
                            JOIN {nation} n ON s.s_nationkey = n.n_nationkey) t WHERE rn = 1""",
    "market_events": """
        SELECT event_id AS id, user_id % 10 AS competitor_id,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS product_id,
               CASE event_type WHEN 'purchase' THEN 'stock_out' WHEN 'error' THEN 'product_removed'
                    WHEN 'signup' THEN 'new_product' WHEN 'view' THEN 'price_increase'
                    ELSE 'price_decrease' END AS event_type,
               value, ts AS detected_at, (event_id % 3 = 0) AS notification_sent
        FROM {events}""",
    # Products addressed by market_events: one per user.
    "market_products": """
        SELECT user_id AS id, user_id % 10 AS competitor_id,
               concat('Item ', CAST(user_id AS STRING)) AS title, concat('item ', CAST(user_id AS STRING)) AS normalized_title,
               CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('group ', CAST(user_id % 7 AS STRING)) END AS category,
               concat('https://s', CAST(user_id % 10 AS STRING), '.example.com/products/', CAST(user_id AS STRING)) AS url,
               concat('https://cdn.example.com/', CAST(user_id AS STRING), '.png') AS image_url,
               CAST(max(value) AS DECIMAL(12,2)) AS current_price, 'USD' AS currency, 'in_stock' AS stock_status
        FROM {events} WHERE user_id % 13 <> 5 GROUP BY user_id""",
    "market_runs": """
        SELECT event_id AS id, user_id % 10 AS competitor_id, ts AS started_at,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END AS status
        FROM {events}""",
    "market_titles": """
        SELECT l.l_suppkey * 1000000 + l.l_partkey AS id, l.l_suppkey AS competitor_id,
               CASE p.p_size % 5 WHEN 0 THEN concat('300m s divine ', p.p_name)
                                 WHEN 1 THEN concat('galaxy ', p.p_name, ' 210m 1s')
                                 WHEN 2 THEN concat(p.p_name, ' knife')
                                 ELSE p.p_name END AS normalized_title,
               CASE WHEN p.p_size % 2 = 0 THEN 'Steal a Brainrot' ELSE p.p_type END AS category,
               CAST(min(l.l_extendedprice) AS DECIMAL(12,2)) AS current_price, 'USD' AS currency,
               max(l.l_shipdate) AS last_checked_at
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        GROUP BY l.l_suppkey, l.l_partkey, p.p_name, p.p_type, p.p_size""",
    "price_texts": """
        SELECT p_partkey AS id,
               CASE p_partkey % 9 WHEN 0 THEN concat('$', t) WHEN 1 THEN concat('€', replace(t, '.', ','))
                    WHEN 2 THEN concat('USD ', t) WHEN 3 THEN concat('  Price: £', t, '  ')
                    WHEN 4 THEN concat('1.', replace(t, '.', ',')) WHEN 5 THEN concat('1,', t)
                    WHEN 6 THEN '' WHEN 7 THEN concat('-', t) ELSE 'call us' END AS raw
        FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS t FROM {part}) x""",
    "sitemap_docs": """
        SELECT s_suppkey AS doc_id, s_suppkey AS competitor_id,
               concat('https://s', CAST(s_suppkey AS STRING), '.example.com') AS base_url,
               concat('<urlset><url><loc>https://www.s', CAST(s_suppkey AS STRING), '.example.com/products/a</loc></url>',
                      '<url><loc> https://s', CAST(s_suppkey AS STRING), '.example.com/product/b?x=1&amp;y=2 </loc></url>',
                      '<url><loc>https://other.example/products/c</loc></url><url><loc>https://s', CAST(s_suppkey AS STRING),
                      '.example.com/blog/d</loc></url></urlset>') AS body
        FROM {supplier}""",
    "stock_texts": """
        SELECT p_partkey AS id, p_brand AS source,
               CASE p_partkey % 6 WHEN 0 THEN 'Add to Cart' WHEN 1 THEN 'SOLD OUT today' WHEN 2 THEN 'Currently unavailable'
                    WHEN 3 THEN 'not available' WHEN 4 THEN '' ELSE 'Some random text' END AS raw
        FROM {part}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _fill(sql: str, name_of) -> str:
    """Replace the `{table}` placeholders; other braces belong to JSON texts."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", name_of(t))
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame over the parquet files of `sf_dir`."""
    if name == "observations":
        return _observations(spark, sf_dir)
    return run_sql(spark, sf_dir, VIEWS[name])


def view_of(spark: SparkSession, sf_dir: str, name: str, **frames: DataFrame) -> DataFrame:
    """The named view over the parquet files of `sf_dir`, but for the tables that are given as frames."""
    return spark.sql(_fill(VIEWS[name], lambda t: "{" + t + "}" if t in frames else f"parquet.`{sf_dir}/{t}.parquet`"), **frames)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_fill(sql, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


#: Rows of a table that one task turns into pages and parses.
PAGES_PER_TASK = 50_000


def run_pages(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """`run_sql` with the rows of the table `name` dealt out before `sql` makes pages of them.

    A table of millions of short rows is a file of a few megabytes, which would be read, and its pages parsed, by one task.
    """
    tasks = tasks_for(table(spark, sf_dir, name), PAGES_PER_TASK)
    dealt = f"(SELECT /*+ REPARTITION({tasks}) */ * FROM parquet.`{sf_dir}/{name}.parquet`)"
    return spark.sql(_fill(sql, lambda t: dealt if t == name else f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(body: str, *names: str, **extra: str) -> str:
    """`body` preceded by the named views (and `extra` ones) as common table expressions."""
    parts = {n: VIEWS[n] for n in names} | extra
    if not parts:
        return body
    ctes = ",\n".join(f"{n} AS ({_fill(sql, str)})" for n, sql in parts.items())
    return f"WITH RECURSIVE {ctes}\n{body}"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line per (region, part, quarter).

    `min_by` combines on the map side, so a quarter that holds a large share of all lines costs no more than any
    other; the equivalent row_number would sort that group in one task.
    """
    lines = table(spark, sf_dir, "lineitem")
    shops = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_regionkey").alias("competitor_id"))
    )
    flag = F.col("l_returnflag")
    return (
        lines.join(shops, lines.l_suppkey == shops.s_suppkey)
        .select(
            "competitor_id",
            F.col("l_partkey").alias("product_key"),
            ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")).alias("scan_no"),
            F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag").alias("o"),
            F.struct(
                F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
                F.when(flag == "N", "in_stock").when(flag == "R", "out_of_stock").otherwise("unknown").alias("stock_status"),
                F.when(F.col("l_linenumber") % 5 == 0, "")
                .otherwise(F.concat(F.lit("cat"), F.col("l_linenumber").cast("string"))).alias("category"),
            ).alias("v"),
        )
        .groupBy("competitor_id", "scan_no", "product_key")
        .agg(F.min_by("v", "o").alias("v"))
        .select("competitor_id", "scan_no", "product_key", "v.*")
    )
