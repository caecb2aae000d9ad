"""Landing jobs. Payloads are built from the test tables as text; the SQL states the expected records from the columns."""

from pyspark.sql import functions as F

from shelfwatch.functions.text import category_from_url, english_category, english_text
from shelfwatch.functions.constants import ENGLISH_CATEGORIES
from shelfwatch.operators import landing, onboarding
from shelfwatch.plans.fixtures import oracle
from shelfwatch.plans.registry import job
from shelfwatch.sources import catalogs, listing_html, product_html, sitemaps, targets

# --- catalog JSON ------------------------------------------------------------------------------------------

ITEM = ["competitor_id", "url", "external_id", "title", "price", "currency", "stock_status", "sku", "image_url", "category"]

CATALOG_PAGES = """
    SELECT p_partkey % 10 AS competitor_id, concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com/') AS base_url,
           CASE WHEN p_size % 4 = 0 THEN concat('Shelf ', CAST(p_size AS STRING)) END AS category, p_partkey AS page_ix,
           concat('{"products":[{"id":', k, ',"title":" ', p_name, ' ","handle":"', slug, '","vendor":"', p_brand,
             '","variants":[{"id":', CAST(p_partkey + 1000000 AS STRING), ',"sku":"S', k, '","price":"', price, '"',
             CASE p_size % 4 WHEN 0 THEN ',"available":true' WHEN 1 THEN ',"available":false' WHEN 2 THEN ',"available":null' ELSE '' END,
             '},{"id":1,"price":"0.01","available":true}],"images":[{"src":"https://cdn.example.com/', k, '.png"}]},',
             '{"id":', k, ',"title":"copy","handle":"', slug, '","variants":[{"price":', price, '}]},',
             '{"id":7,"title":"no handle","variants":[]},{"id":8,"title":"  ","handle":"untitled","variants":[]},',
             '{"id":', k, ',"title":"extra","handle":"extra-', k, '","vendor":"","product_type":"', p_type, '","variants":[]}]}') AS body
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS slug,
                 CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price FROM {part}) x"""

_SHOP = "p_partkey % 10 AS competitor_id"
_BASE = "concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com"
_CATALOG_MAIN = f"""
    SELECT {_SHOP}, {_BASE}/products/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS url,
           concat(CAST(p_partkey AS STRING), ':', CAST(p_partkey + 1000000 AS STRING)) AS external_id, p_name AS title,
           CAST(p_retailprice AS DECIMAL(12,2)) AS price, 'USD' AS currency,
           CASE WHEN p_size % 4 IN (0, 3) THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
           concat('S', CAST(p_partkey AS STRING)) AS sku, concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '.png') AS image_url,
           CASE WHEN p_size % 4 = 0 THEN concat('Shelf ', CAST(p_size AS STRING)) ELSE p_brand END AS category FROM part"""
_CATALOG_COPY = f"""
    SELECT {_SHOP}, {_BASE}/products/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)), CAST(p_partkey AS STRING), 'copy',
           CAST(p_retailprice AS DECIMAL(12,2)), 'USD', 'in_stock', NULL, NULL,
           CASE WHEN p_size % 4 = 0 THEN concat('Shelf ', CAST(p_size AS STRING)) ELSE 'Uncategorized' END FROM part"""
_CATALOG_EXTRA = f"""
    SELECT {_SHOP}, {_BASE}/products/extra-', CAST(p_partkey AS STRING)), CAST(p_partkey AS STRING), 'extra', NULL, 'USD',
           'in_stock', NULL, NULL, CASE WHEN p_size % 4 = 0 THEN concat('Shelf ', CAST(p_size AS STRING)) ELSE p_type END FROM part"""


@job("extract_catalog_json", f"{_CATALOG_MAIN} UNION ALL {_CATALOG_COPY} UNION ALL {_CATALOG_EXTRA}")
def extract_catalog_json(s):
    return catalogs.extract_catalog_json(s.pages(CATALOG_PAGES)).select(*ITEM)


@job("dedupe_catalog", f"{_CATALOG_MAIN} UNION ALL {_CATALOG_EXTRA}")
def dedupe_catalog(s):
    return catalogs.dedupe_catalog(catalogs.extract_catalog_json(s.pages(CATALOG_PAGES))).select(*ITEM)


@job("dedupe_catalog_by_id", """
    SELECT l_suppkey AS competitor_id, concat('k', CAST(l_partkey % 1000 AS VARCHAR)) AS catalog_key, min(l_orderkey * 10 + l_linenumber) AS item_ix
    FROM lineitem GROUP BY 1, 2""")
def dedupe_catalog_by_id(s):
    """First line per supplier and part group: many copies per key, from the largest table."""
    none = F.lit(None).cast("string")
    lines = s.table("lineitem").select(
        F.col("l_suppkey").alias("competitor_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("item_ix"),
        F.concat(F.lit("https://x.example.com/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit("k"), (F.col("l_partkey") % 1000).cast("string")).alias("external_id"),
        *[none.alias(c) for c in ("title", "currency", "stock_status", "sku", "image_url", "category")],
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )
    out = catalogs.dedupe_catalog(lines, by_external_id=True)
    return out.select("competitor_id", F.col("external_id").alias("catalog_key"), "item_ix")


# --- category API JSON -------------------------------------------------------------------------------------

CATEGORY_PAGES = """
    SELECT p_partkey % 10 AS competitor_id, concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com') AS base_url,
           p_brand AS category_id, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE '' END AS currency,
           CAST(NULL AS STRING) AS category_name, p_partkey AS page_ix,
           concat('{"data":[{"id":', CASE WHEN p_size % 2 = 0 THEN concat('"', k, '"') ELSE k END,
             ',"name":"محلي - ', p_name, '","url":"', CASE WHEN p_size % 3 = 0 THEN '/en/p' ELSE 'https://x.example.com/p' END, k,
             '","price":', price, ',"currency":"SAR","is_available":', CASE WHEN p_size % 5 = 0 THEN 'false' ELSE 'true' END,
             ',"is_out_of_stock":', CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END, ',"sku":null,"category":',
             CASE p_size % 3 WHEN 0 THEN '{"name":"ماب السرقة"}' WHEN 1 THEN concat('"', p_type, '"') ELSE 'null' END,
             ',"image":', CASE p_size % 3 WHEN 0 THEN '{"url":"/img/a.png"}' WHEN 1 THEN '"https://cdn.example.com/b.png"' ELSE '{}' END,
             ',"original_image":"/img/c.png"},',
             '{"id":5,"name":"","url":"/dropped"},{"name":"Status only","custom_url":"/s', k, '","status":"sale"}],"cursor":{"next":null}}') AS body
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price FROM {part}) x"""

_FIRST = """CASE p_size % 3 WHEN 0 THEN 'Steal a Brainrot' WHEN 1 THEN p_type ELSE 'Uncategorized' END"""
_NAMED = f"arg_min({_FIRST}, p_partkey) OVER (PARTITION BY p_partkey % 10, p_brand)"


@job("extract_category_api_json", f"""
    SELECT {_SHOP}, CASE WHEN p_size % 3 = 0 THEN {_BASE}/en/p', CAST(p_partkey AS STRING))
                         ELSE concat('https://x.example.com/p', CAST(p_partkey AS STRING)) END AS url,
           CAST(p_partkey AS STRING) AS external_id, p_name AS title, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
           CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'SAR' END AS currency,
           CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status, CAST(NULL AS STRING) AS sku,
           CASE p_size % 3 WHEN 0 THEN {_BASE}/img/a.png') WHEN 1 THEN 'https://cdn.example.com/b.png' ELSE {_BASE}/img/c.png') END AS image_url,
           {_NAMED} AS category FROM part
    UNION ALL
    SELECT {_SHOP}, {_BASE}/s', CAST(p_partkey AS STRING)), NULL, 'Status only', NULL,
           'USD', 'in_stock', NULL, NULL, {_NAMED} FROM part""")
def extract_category_api_json(s):
    return catalogs.extract_category_api_json(s.pages(CATEGORY_PAGES)).select(*ITEM)


# --- GraphQL JSON ------------------------------------------------------------------------------------------

GRAPHQL_PAGES = """
    SELECT p_partkey % 10 AS competitor_id, concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com') AS base_url,
           concat('brand-', CAST(p_size AS STRING)) AS handle, p_partkey AS page_ix,
           concat('{"data":{"collection":{"title":', CASE WHEN p_partkey % 4 = 0 THEN concat('"', p_brand, '"') ELSE 'null' END,
             ',"products":{"edges":[{"node":{"id":"gid://shop/Product/', k, '","title":"', p_name, '","handle":"', slug,
             '","vendor":"V","productType":"T","images":{"edges":[{"node":{"url":"https://cdn.example.com/', k, '.png"}}]},"variants":{"edges":[',
             '{"node":{"id":"gid://shop/Variant/1","sku":"A","availableForSale":false,"price":{"amount":"1.00","currencyCode":"USD"}}},',
             '{"node":{"id":"gid://shop/Variant/2","sku":"B","availableForSale":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END,
             ',"price":{"amount":"', price, '","currencyCode":"EUR"}}}]}}},',
             '{"node":{"id":"bare","title":"bare","handle":"bare-', k, '"}}],"pageInfo":{"hasNextPage":false}}}}}') AS body
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS slug,
                 CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price FROM {part}) x"""

_TITLED = """coalesce(last_value(CASE WHEN p_partkey % 4 = 0 THEN p_brand END IGNORE NULLS) OVER (
    PARTITION BY p_partkey % 10, p_size ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    concat('Brand ', CAST(p_size AS STRING)))"""


@job("extract_graphql_json", f"""
    SELECT {_SHOP}, {_BASE}/product/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS url,
           concat(CAST(p_partkey AS STRING), CASE WHEN p_size % 2 = 0 THEN ':2' ELSE ':1' END) AS external_id, p_name AS title,
           CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) ELSE 1.00 END AS price,
           CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
           CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
           CASE WHEN p_size % 2 = 0 THEN 'B' ELSE 'A' END AS sku,
           concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '.png') AS image_url, {_TITLED} AS category FROM part
    UNION ALL
    SELECT {_SHOP}, {_BASE}/product/bare-', CAST(p_partkey AS STRING)), 'bare', 'bare', NULL, 'USD', 'out_of_stock', NULL, NULL,
           {_TITLED} FROM part""")
def extract_graphql_json(s):
    return catalogs.extract_graphql_json(s.pages(GRAPHQL_PAGES)).select(*ITEM)


# --- product and listing HTML ------------------------------------------------------------------------------

PRODUCT_PAGES = """
    SELECT p_partkey % 10 AS competitor_id, p_partkey AS item_ix, concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com') AS base_url,
           concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com/product/', CAST(p_partkey AS STRING)) AS url, p_partkey AS page_id,
           concat('<html><head><script type="application/ld+json">{"@type":"WebSite","name":"shop"}</script>',
             CASE WHEN p_size % 5 = 4 THEN '' ELSE concat('<script async type="application/ld+json" data-x="1">',
               CASE p_size % 5 WHEN 1 THEN '[{"@type":"Thing"},' WHEN 2 THEN '{"@graph":[{"@type":"Org"},' ELSE '' END,
               '{"@type":', CASE WHEN p_size % 5 = 3 THEN '["Thing","Product"]' ELSE '"Product"' END, ',"name":"', p_name,
               ' &amp;amp; co","brand":', CASE WHEN p_size % 2 = 0 THEN concat('{"name":"', p_brand, '"}') ELSE concat('"', p_brand, '"') END,
               ',"sku":"gid://shop/Variant/', k, '","image":["https://cdn.example.com/', k, '.png"],"offers":',
               CASE WHEN p_size % 3 = 0 THEN '[' ELSE '' END, '{"price":', CASE WHEN p_size % 2 = 0 THEN concat('"', price, '"') ELSE price END,
               ',"priceCurrency":"EUR","availability":"https://schema.org/', CASE WHEN p_size % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END, '"}',
               CASE WHEN p_size % 3 = 0 THEN ']' ELSE '' END, '}',
               CASE p_size % 5 WHEN 1 THEN ']' WHEN 2 THEN ']}' ELSE '' END, '</script>') END,
             '</head><body>state:{id:"gid://shopify/Product/', k, '",title:"state ', p_name, '",price:$R[3]={amount:"2.50"',
             ',currencyCode:"GBP"},productType:"State &amp; type",availableForSale:!0}</body></html>') AS html
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price FROM {part}) x"""


@job("extract_html_products", f"""
    SELECT {_SHOP}, {_BASE}/product/', CAST(p_partkey AS STRING)) AS url,
           CASE WHEN p_size % 5 = 4 THEN CAST(p_partkey AS STRING) ELSE concat(CAST(p_partkey AS STRING), ':', CAST(p_partkey AS STRING)) END AS external_id,
           CASE WHEN p_size % 5 = 4 THEN concat('state ', p_name) ELSE concat(p_name, ' & co') END AS title,
           CASE WHEN p_size % 5 = 4 THEN 2.50 ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS price,
           CASE WHEN p_size % 5 = 4 THEN 'GBP' ELSE 'EUR' END AS currency,
           CASE WHEN p_size % 5 = 4 OR p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
           CASE WHEN p_size % 5 <> 4 THEN concat('gid://shop/Variant/', CAST(p_partkey AS STRING)) END AS sku,
           CASE WHEN p_size % 5 <> 4 THEN concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '.png') END AS image_url,
           CASE WHEN p_size % 5 = 4 THEN 'State & type' ELSE p_brand END AS category FROM part""")
def extract_html_products(s):
    return product_html.extract_html_products(s.pages(PRODUCT_PAGES)).select(*ITEM)


@job("jsonld_products", """
    SELECT p_partkey AS page_id, concat(p_name, ' & co') AS name_text FROM part WHERE p_size % 5 <> 4""")
def jsonld_products(s):
    found = product_html.with_jsonld_product(s.pages(PRODUCT_PAGES).select("page_id", "html")).where("product is not null")
    name = F.try_variant_get("product", "$.name", "string")
    return found.select("page_id", F.replace(name, F.lit("&amp;"), F.lit("&")).alias("name_text"))


LISTING_PAGES = """
    SELECT p_partkey % 10 AS competitor_id, p_partkey AS page_ix, concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com') AS base_url,
           concat('https://s', CAST(p_partkey % 10 AS STRING), '.example.com/collections/big-deals?page=2') AS url,
           concat('<html><body><div class="grid"><div class="card hot"><a class="link" href="/items/', k, '"><h2 class="name">', p_name,
             '</h2></a><img data-src="/img/', k, '.png"><span class="price">$', price, '</span><p class="stock">',
             CASE WHEN p_size % 2 = 0 THEN 'Sold out' ELSE 'Add to cart' END, '</p></div>',
             '<div class="card"><span>No link</span></div><div class="card"><a href="https://x.example.com/b', k, '">Bare ', p_brand,
             ' &amp; more</a></div></div></body></html>') AS html
    FROM (SELECT *, CAST(p_partkey AS STRING) AS k, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price FROM {part}) x"""


@job("extract_listing_cards", f"""
    SELECT {_SHOP}, {_BASE}/items/', CAST(p_partkey AS STRING)) AS url, p_name AS title, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
           'USD' AS currency, CASE WHEN p_size % 2 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status,
           {_BASE}/img/', CAST(p_partkey AS STRING), '.png') AS image_url, 'Big Deals' AS category FROM part
    UNION ALL
    SELECT {_SHOP}, concat('https://x.example.com/b', CAST(p_partkey AS STRING)), concat('Bare ', p_brand, ' & more'), NULL, 'USD',
           'unknown', NULL, 'Big Deals' FROM part""")
def extract_listing_cards(s):
    selectors = {"product_card": ".grid div.card", "title": ".name", "price": "span.price", "stock": ".stock"}
    pages = s.pages(LISTING_PAGES).withColumn("selectors", F.create_map(*[F.lit(x) for kv in selectors.items() for x in kv]))
    return listing_html.extract_listing_cards(pages).select(
        "competitor_id", "url", "title", "price", "currency", "stock_status", "image_url", "category"
    )


# --- sitemaps and discovery --------------------------------------------------------------------------------

@job("sitemap_locs", oracle("""
    SELECT doc_id, CAST(pos AS INT) AS pos, replace(l[pos + 1], '&amp;', '&') AS loc FROM (
      SELECT doc_id, regexp_extract_all(body, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1) AS l,
             unnest(range(len(regexp_extract_all(body, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1)))) AS pos FROM sitemap_docs) t
    """, "sitemap_docs"))
def sitemap_locs(s):
    return sitemaps.sitemap_locs(s.sitemap_docs)


@job("sitemap_product_urls", oracle("""
    SELECT doc_id, unnest(['https://www.s' || doc_id || '.example.com/products/a',
                           'https://s' || doc_id || '.example.com/product/b?x=1&y=2']) AS url FROM sitemap_docs""", "sitemap_docs"))
def sitemap_product_urls(s):
    return sitemaps.sitemap_product_urls(s.sitemap_docs).select("doc_id", "url")


# One sitemap tree per supplier: the root names two inner documents, the second of them one more.
SITEMAP_TREE = """
    SELECT s_suppkey AS competitor_id, base AS base_url, concat(base, '/', d.doc) AS doc_url,
           CASE d.doc
             WHEN 'sitemap.xml' THEN concat('<loc>', base, '/one.xml</loc><loc>', base, '/two.xml</loc><loc>https://other.example/x.xml</loc>')
             WHEN 'one.xml' THEN concat('<loc>', base, '/products/a</loc><loc>', base, '/products/b</loc><loc>', base, '/never.xml</loc>')
             WHEN 'two.xml' THEN concat('<loc>', base, '/three.xml</loc><loc>', base, '/sitemap.xml</loc>')
             WHEN 'three.xml' THEN concat('<loc>', base, '/product/c</loc><loc>', base, '/products/a</loc>')
             ELSE concat('<loc>', base, '/products/never</loc>') END AS body
    FROM (SELECT s_suppkey, concat('https://s', CAST(s_suppkey AS STRING), '.example.com') AS base FROM {supplier}) x
         CROSS JOIN (SELECT 'sitemap.xml' AS doc UNION ALL SELECT 'one.xml' UNION ALL SELECT 'two.xml' UNION ALL SELECT 'three.xml'
                     UNION ALL SELECT 'never.xml') d"""


@job("sitemap_closure", """
    SELECT s_suppkey AS competitor_id, concat('https://s', CAST(s_suppkey AS VARCHAR), '.example.com', unnest(['/products/a', '/products/b', '/product/c'])) AS url
    FROM supplier""")
def sitemap_closure(s):
    return sitemaps.sitemap_closure(s.sql(SITEMAP_TREE)).select("competitor_id", "url")


@job("collection_closure", """
    SELECT s_suppkey AS competitor_id, unnest(['deep', concat('c', CAST(s_suppkey AS VARCHAR))]) AS handle FROM supplier""")
def collection_closure(s):
    handles = F.concat(F.lit("/collections/all /collections/c"), F.col("competitor_id").cast("string"), F.lit(" /collections/deep"))
    tree = s.sql(SITEMAP_TREE)
    marked = F.when(F.col("doc_url").endswith("three.xml"), F.concat("body", handles)).otherwise(F.col("body"))
    return sitemaps.collection_closure(tree.withColumn("body", marked)).select("competitor_id", "handle")


COLLECTION_TEXTS = """
    SELECT s_suppkey AS doc_id, concat('<a href="/collections/all">x</a><loc>https://e.example/collections/c', CAST(s_suppkey AS STRING),
           '</loc> /collections/adopt-me/ /collections/c', CAST(s_suppkey AS STRING), '?a /collections/new') AS body FROM {supplier}"""


@job("collection_handles", """
    SELECT s_suppkey AS doc_id, 0 AS pos, concat('c', CAST(s_suppkey AS VARCHAR)) AS handle FROM supplier
    UNION ALL SELECT s_suppkey, 1, 'adopt-me' FROM supplier""")
def collection_handles(s):
    return sitemaps.collection_handles(s.sql(COLLECTION_TEXTS))


_SHOPS = """
    SELECT s_suppkey AS id, s_name AS name, concat('https://s', CAST(s_suppkey AS STRING), '.example.com/') AS base_url, s_suppkey % 6 AS kind
    FROM {supplier}"""


def _shops(s):
    """Competitor records whose urls and config cover every onboarding rule."""
    i, kind = F.col("id"), F.col("kind")
    site = F.concat(F.lit("https://s"), i.cast("string"), F.lit(".example.com"))
    texts = F.array().cast("array<string>")
    return s.sql(_SHOPS).withColumns({
        "listing_urls": F.when(kind == 1, F.array(F.concat(site, F.lit("/collections/big-deals/")), F.concat(site, F.lit("/about"))))
        .when(kind == 2, F.array(F.concat(site, F.lit("/en/-/c"), i.cast("string"), F.lit("/?lang=en"))))
        .when(kind == 3, F.array(F.concat(site, F.lit("/list.html")))).otherwise(texts),
        "selector_config": F.when(kind == 1, F.create_map(F.lit("collection_handles"), F.lit('["c1","c2"]')))
        .when(kind == 4, F.create_map(F.lit("include_all_products"), F.lit("false")))
        .when(kind == 5, F.create_map(F.lit("category_ids"), F.lit('["7"," 8 ","7"]')))
        .otherwise(F.create_map().cast("map<string,string>")),
        "scrape_type": F.when(kind.isin(0, 3), "generic_selector").when(kind.isin(1, 2), "shopify_json").when(kind == 4, "custom"),
    })


@job("normalize_competitors", """
    SELECT s_suppkey AS id,
           CASE WHEN s_suppkey % 6 IN (2, 5) THEN 'salla_json' WHEN s_suppkey % 6 = 3 THEN 'generic_selector' ELSE 'shopify_json' END AS scrape_type,
           CASE s_suppkey % 6 WHEN 0 THEN 'discover_collections=true;include_all_products=true'
                WHEN 1 THEN 'collection_handles=["c1","c2"];discover_collections=true;include_all_products=true'
                WHEN 4 THEN 'discover_collections=true;include_all_products=false'
                WHEN 5 THEN 'category_ids=["7"," 8 ","7"]' ELSE '' END AS config,
           CASE WHEN s_suppkey % 6 = 1 THEN 2 WHEN s_suppkey % 6 IN (2, 3) THEN 1 ELSE 0 END AS n_listing FROM supplier""")
def normalize_competitors(s):
    rows = onboarding.normalize_competitors(_shops(s))
    config = F.array_join(F.transform(F.array_sort(F.map_entries("selector_config")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("id", "scrape_type", config.alias("config"), F.size("listing_urls").alias("n_listing"))


COLLECTIONS = """
    SELECT s.s_suppkey AS competitor_id, CAST(n.n_nationkey AS BIGINT) AS pos, concat('c', CAST(n.n_nationkey AS STRING)) AS handle,
           CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name ELSE '' END AS title, n.n_nationkey % 5 AS products_count
    FROM {supplier} s JOIN {nation} n ON s.s_nationkey % 5 = n.n_regionkey"""


@job("fetch_targets", oracle("""
    SELECT s_suppkey AS competitor_id, concat(base, '/collections/big-deals/products.json') AS url, 'Big Deals' AS category
    FROM shops WHERE s_suppkey % 6 = 1
    UNION ALL
    SELECT competitor_id, concat(base, '/collections/', handle, '/products.json'), coalesce(nullif(title, ''), concat('C', substr(handle, 2)))
    FROM collections JOIN shops ON competitor_id = s_suppkey
    WHERE products_count <> 0 AND (s_suppkey % 6 <> 1 OR handle IN ('c1', 'c2'))
    UNION ALL
    SELECT s_suppkey, concat(base, '/products.json'), NULL FROM shops
    WHERE s_suppkey % 6 <> 4 OR s_suppkey NOT IN (SELECT competitor_id FROM collections WHERE products_count <> 0)""",
    collections=COLLECTIONS, shops="SELECT s_suppkey, concat('https://s', CAST(s_suppkey AS STRING), '.example.com') AS base FROM {supplier}"))
def fetch_targets(s):
    return targets.fetch_targets(_shops(s), s.sql(COLLECTIONS)).select("competitor_id", "url", "category")


PAGE_RESULTS = """
    SELECT o_custkey AS competitor_id, o_orderpriority AS target, CAST(o_orderkey % 7 + 1 AS INT) AS page_no,
           min(o_totalprice) > 20000 AS ok, CAST(floor(max(o_totalprice) / 40000) AS INT) AS n_products
    FROM {orders} GROUP BY 1, 2, 3"""


@job("take_pages", oracle("""
    SELECT competitor_id, target, page_no FROM results r
    WHERE NOT EXISTS (
      SELECT 1 FROM range(1, 100) g(n) WHERE n <= r.page_no AND NOT EXISTS (
        SELECT 1 FROM results q WHERE q.competitor_id = r.competitor_id AND q.target = r.target AND q.page_no = n AND q.ok AND q.n_products > 0))""",
    results=PAGE_RESULTS))
def take_pages(s):
    return targets.take_pages(s.sql(PAGE_RESULTS), ["competitor_id", "target"]).select("competitor_id", "target", "page_no")


@job("source_fallback", """
    SELECT o_custkey AS competitor_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS source_rank, o_orderkey AS item_ix FROM orders o
    WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) = (SELECT min(CAST(substr(q.o_orderpriority, 1, 1) AS INT)) FROM orders q
                                                        WHERE q.o_custkey = o.o_custkey)""")
def source_fallback(s):
    items = s.table("orders").select(
        F.col("o_custkey").alias("competitor_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("source_rank"),
        F.col("o_orderkey").alias("item_ix"),
    )
    return targets.source_fallback(items)


@job("category_ids", """
    SELECT s_suppkey AS competitor_id, CAST(s_suppkey AS VARCHAR) AS category_id FROM supplier WHERE s_suppkey % 6 = 2
    UNION ALL SELECT s_suppkey, unnest(['7', '8']) FROM supplier WHERE s_suppkey % 6 = 5
    UNION ALL SELECT DISTINCT l_suppkey, unnest([CAST(l_linenumber AS VARCHAR), CAST(l_partkey + 10 AS VARCHAR)]) FROM lineitem WHERE l_suppkey % 6 NOT IN (2, 5)""")
def category_ids(s):
    # every line is a listing page of its supplier, with one list element and one link
    landed = s.table("lineitem").select(
        F.col("l_suppkey").alias("competitor_id"), F.col("l_orderkey").cast("long").alias("page_ix"),
        F.format_string("<a href='/x/c%d'></a><salla-products-list id=\"1\" source-value=\"%d\"></salla-products-list>",
                        F.col("l_partkey") + 10, F.col("l_linenumber")).alias("html"),
    )
    return targets.category_ids(_shops(s), landed).select("competitor_id", "category_id")


@job("category_from_url", """
    SELECT c_custkey AS id, concat('Mm2', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), ' Pets') AS category FROM customer""")
def category_from_url_job(s):
    url = F.concat(F.lit("https://x.example.com/collections/mm2"), F.lower("c_mktsegment"), F.lit("-pets?sort=1"))
    return s.table("customer").select(F.col("c_custkey").alias("id"), category_from_url(url).alias("category"))


@job("english_titles", """
    SELECT p_partkey AS id,
           CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('ماب ', p_partkey::VARCHAR, ' - ٣') WHEN 2 THEN p_name ELSE concat(p_name, ' & co') END AS title,
           CASE p_partkey % 4 WHEN 0 THEN 'Steal a Brainrot' WHEN 1 THEN NULL WHEN 2 THEN p_type ELSE 'Robux' END AS category FROM part""")
def english_titles(s):
    i = F.col("p_partkey") % 4
    local = F.concat(F.lit("ماب "), F.col("p_partkey").cast("string"))
    title = (
        F.when(i == 0, F.concat(local, F.lit(" - "), "p_name")).when(i == 1, F.concat(local, F.lit(" - ٣")))
        .when(i == 2, F.concat(F.lit("x - "), "p_name", F.lit(" - "), F.lit("٣"))).otherwise(F.concat("p_name", F.lit(" &amp; co")))
    )
    category = F.when(i == 0, "ماب السرقة").when(i == 2, F.col("p_type")).when(i == 3, "روبوكس")
    return s.table("part").select(
        F.col("p_partkey").alias("id"), english_text(title).alias("title"), english_category(category, ENGLISH_CATEGORIES).alias("category")
    )


@job("seed_competitors", """
    SELECT c_name AS name, concat('https://s', CAST(c_custkey AS VARCHAR), '.example.com/') AS base_url FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def seed_competitors(s):
    seeds = s.table("customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("https://s"), F.col("c_custkey").cast("string"), F.lit(".example.com/")).alias("base_url")
    )
    return onboarding.seed_competitors(seeds, s.competitors)


REQUESTS = """
    SELECT o_orderkey AS id, o_custkey % 200 AS competitor_id, CASE o_orderkey % 4 WHEN 0 THEN concat(' https://www.S', CAST(o_custkey % 200 AS STRING), '.example.com/collections/a ')
           WHEN 1 THEN '/collections/a' WHEN 2 THEN concat('https://s', CAST(o_custkey % 100 AS STRING), '.example.com/collections/b')
           ELSE concat('ftp://s', CAST(o_custkey AS STRING), '.example.com/') END AS collection_url
    FROM {orders}"""


@job("valid_collection_urls", oracle("""
    SELECT r.competitor_id, trim(r.collection_url) AS collection_url FROM requests r JOIN supplier s ON r.competitor_id = s.s_suppkey
    WHERE r.id % 4 = 0 OR (r.id % 4 = 2 AND r.collection_url = concat('https://s', CAST(r.competitor_id AS VARCHAR), '.example.com/collections/b'))""",
    requests=REQUESTS))
def valid_collection_urls(s):
    return onboarding.valid_collection_urls(s.sql(REQUESTS), s.competitors)


# --- normalisation -----------------------------------------------------------------------------------------

PARSED = """
    SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL
             WHEN 4 THEN CAST(concat('1', t) AS DECIMAL(12,2)) WHEN 5 THEN CAST(concat('1', t) AS DECIMAL(12,2)) ELSE CAST(t AS DECIMAL(12,2)) END AS price,
           CASE p_partkey % 9 WHEN 1 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'USD' END AS currency
    FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS t FROM part) x"""


@job("parse_prices", oracle(
    f"SELECT a.id, b.raw, a.price, a.currency FROM ({PARSED}) a JOIN price_texts b ON a.id = b.id", "price_texts"))
def parse_prices(s):
    return landing.parse_prices(s.price_texts)


@job("price_rejects", f"""
    SELECT currency, count(*) AS n_texts, count(*) FILTER (WHERE price IS NULL) AS n_rejected FROM ({PARSED}) t GROUP BY currency""")
def price_rejects(s):
    return landing.price_rejects(landing.parse_prices(s.price_texts))


@job("normalize_titles", """
    SELECT p_partkey AS id, concat(p_name, ' ', lower(p_brand[:5]), ' ', p_brand[7:], ' xl') AS normalized FROM part""")
def normalize_titles(s):
    raw = F.concat(F.lit("  "), F.initcap("p_name"), F.lit("\t- "), "p_brand", F.lit(" (XL)!"))
    return landing.normalize_titles(s.table("part").select(F.col("p_partkey").alias("id"), raw.alias("raw")), "raw").drop("raw")


@job("normalize_documents")
def normalize_documents(s):
    """Whole texts in four languages through the same rule."""
    return landing.normalize_titles(s.table("documents").select("doc_id", "text"), "text").select("doc_id", "normalized")


@job("classify_stock", oracle("""
    SELECT id, source, raw, CASE WHEN id % 6 IN (0, 3) THEN 'in_stock' WHEN id % 6 IN (1, 2) THEN 'out_of_stock' ELSE 'unknown' END AS stock_status
    FROM stock_texts""", "stock_texts"))
def classify_stock(s):
    return landing.classify_stock_texts(s.stock_texts)


@job("stock_counts", oracle("""
    SELECT source, CASE WHEN id % 6 IN (0, 3) THEN 'in_stock' WHEN id % 6 IN (1, 2) THEN 'out_of_stock' ELSE 'unknown' END AS stock_status,
           count(*) AS n FROM stock_texts GROUP BY 1, 2""", "stock_texts"))
def stock_counts(s):
    return landing.stock_counts(landing.classify_stock_texts(s.stock_texts))


LINKS = """
    SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h
           ELSE concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), h) END AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) t"""


@job("page_links", LINKS)
def page_links(s):
    return landing.page_links(s.table("pages"))


@job("links_per_host", f"""
    SELECT lower(regexp_extract(link, '://([^/?#]*)', 1)) AS host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM ({LINKS}) l GROUP BY 1""")
def links_per_host(s):
    return landing.links_per_host(landing.page_links(s.table("pages")))
