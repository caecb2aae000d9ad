"""Golden payloads of every dialect, discovery and onboarding."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwatch.operators import onboarding
from shelfwatch.sources import catalogs, listing_html, product_html, sitemaps, targets
from shelfwatch.sources.tables import read_documents


def pages(spark, bodies, **extra):
    rows = spark.createDataFrame([(1, "https://example.com", i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)],
                                 "competitor_id long, base_url string, page_ix long, body string")
    return rows.withColumns({k: F.lit(v).cast("string") for k, v in extra.items()})


def test_catalog_json(spark):
    kettle = {"id": 31, "title": "Copper Kettle", "handle": "copper-kettle", "images": [{"src": "https://img.test/kettle.webp"}],
              "variants": [{"id": 77, "available": True, "price": "48.20", "sku": "KT-1"}, {"id": 78, "price": "9"}]}
    number = {"id": 32, "title": "  Trivet ", "handle": "trivet", "vendor": "Ironworks", "product_type": "Tables", "variants": [{"id": 0, "price": 6.75}]}
    null_flag = {"id": 33, "title": "Ladle", "handle": "ladle", "product_type": "Spoons", "variants": [{"id": 5, "available": None, "price": "3,4"}]}
    bare = {"id": 34, "title": "Spare lid", "handle": "lid", "variants": []}
    odd = {"id": 35, "title": "Text for images", "handle": "odd", "images": "n/a", "variants": [{"id": 2, "price": None}]}
    left_out = [{"id": 36, "title": "", "handle": "empty-title"}, {"id": 37, "title": "Handle missing"}]
    bodies = [{"products": [kettle, number]}, "<html>", {"products": []}, {"products": [null_flag, *left_out, bare, odd]}]
    out = catalogs.extract_catalog_json(pages(spark, bodies, category=None)).orderBy("item_ix").collect()
    assert [r.title for r in out] == ["Copper Kettle", "Trivet", "Ladle", "Spare lid", "Text for images"]
    assert [r.external_id for r in out] == ["31:77", "32", "33:5", "34", "35:2"]
    assert [r.price for r in out] == [Decimal("48.20"), Decimal("6.75"), Decimal("3.40"), None, None]
    assert [r.stock_status for r in out] == ["in_stock", "in_stock", "out_of_stock", "in_stock", "in_stock"]
    assert [r.category for r in out] == ["Uncategorized", "Ironworks", "Spoons", "Uncategorized", "Uncategorized"]
    assert (out[0].image_url, out[0].url, out[0].sku) == ("https://img.test/kettle.webp", "https://example.com/products/copper-kettle", "KT-1")
    assert {r.image_url for r in out[1:]} == {None}
    assert catalogs.extract_catalog_json(pages(spark, [{"products": [number]}], category="Hearth")).first().category == "Hearth"


def test_pages_with_very_many_products_keep_their_order(spark):
    positions = spark.createDataFrame([(0, 2**31 - 1), (1, 0), (2**31 - 1, 5)], "page_ix int, pos int")
    found = [r.item_ix for r in positions.select(catalogs._position()).collect()]
    assert found == sorted(set(found)) and found[0] < found[1]


def graph(title, nodes):
    return {"data": {"collection": {"title": title, "products": {"edges": [{"node": n} for n in nodes]}}}}


def test_graphql_json(spark):
    variant = {"id": "gid://shopify/ProductVariant/902", "sku": "LMP", "availableForSale": True, "price": {"amount": "17.05", "currencyCode": "CAD"}}
    lamp = {"id": "gid://shopify/Product/901", "title": "Desk Lamp", "handle": "desk-lamp", "vendor": "Glow", "productType": "Lights",
            "images": {"edges": [{"node": {"url": "https://img.test/lamp.jpg"}}]}, "variants": {"edges": [{"node": variant}]}}
    stub = {"id": None, "title": "Stub", "handle": "stub"}
    bodies = [graph("Office", [lamp]), {"errors": ["rate"]}, graph(None, [stub])]
    lit, dark = catalogs.extract_graphql_json(pages(spark, bodies, handle="office-lights")).orderBy("item_ix").collect()
    assert (lit.external_id, lit.price, lit.currency, lit.sku, lit.stock_status) == ("901:902", Decimal("17.05"), "CAD", "LMP", "in_stock")
    assert (lit.url, lit.category, lit.image_url) == ("https://example.com/product/desk-lamp", "Office", "https://img.test/lamp.jpg")
    assert (dark.external_id, dark.price, dark.stock_status, dark.category) == (None, None, "out_of_stock", "Office")
    assert catalogs.extract_graphql_json(pages(spark, [graph(None, [stub])], handle="office-lights")).first().category == "Office Lights"


def test_category_api_json(spark):
    """The first product names the category of all; objects and texts are both read."""
    first = {"id": "55", "name": "روبوكس حزمة - Robux Bundle", "url": "https://market.test/item/55", "price": 20.5, "currency": "AED", "sku": "RB",
             "is_available": True, "is_out_of_stock": False, "category": {"name": "روبوكس"}, "image": {"url": "https://img.test/55.png"}}
    second = {"id": 56, "title": "Plain title", "custom_url": "item/56", "is_available": False, "category": "Not used", "image": "56.png"}
    third = {"name": "On sale", "url": "/item/57", "status": "sale", "price": {"amount": 1.25, "currency": "AED"}, "original_image": "/57.png"}
    bodies = [{"data": [first, second]}, {"data": [{"name": "without address"}, third]}]
    out = catalogs.extract_category_api_json(pages(spark, bodies, category_id="70", currency="AED", category_name=None)).orderBy("item_ix").collect()
    assert [r.title for r in out] == ["Robux Bundle", "Plain title", "On sale"] and {r.category for r in out} == {"Robux"}
    assert [r.url for r in out] == ["https://market.test/item/55", "https://example.com/item/56", "https://example.com/item/57"]
    assert [r.image_url for r in out] == ["https://img.test/55.png", "https://example.com/56.png", "https://example.com/57.png"]
    assert [(r.external_id, r.stock_status) for r in out] == [("55", "in_stock"), ("56", "out_of_stock"), (None, "in_stock")]
    assert {r.currency for r in out} == {"AED"} and (out[0].price, out[0].sku) == (Decimal("20.50"), "RB")


def product_page(*blocks, state=""):
    scripts = "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)
    return f"<html><head>{scripts}</head><body>{state}</body></html>"


def test_product_html(spark):
    teapot = {"@type": "Product", "name": "Teapot", "brand": {"name": "Clay & Co"}, "sku": "gid://shopify/ProductVariant/612",
              "image": ["https://img.test/teapot.png"], "offers": {"price": "33.90", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}}
    described = product_page({"@type": "Organization"}, "{not json", teapot, state='{id:"gid://shopify/Product/611"} availableForSale:!0')
    state = ('{title:"Caf&eacute; cup",id:"gid://shopify/Product/620",price:$R[3]={amount:"7,10",currencyCode:"CHF"},availableForSale:!1,'
             'productType:"",url:"https://cdn.shopify.com/cup.png"}')
    rows = spark.createDataFrame(
        [(1, i, "https://example.com", f"https://example.com/product/{i}", h) for i, h in enumerate([None, described, product_page(), product_page(state=state)])],
        "competitor_id long, item_ix long, base_url string, url string, html string")
    pot, cup = product_html.extract_html_products(rows).orderBy("item_ix").collect()
    assert (pot.title, pot.category, pot.external_id, pot.sku) == ("Teapot", "Clay & Co", "611:612", "gid://shopify/ProductVariant/612")
    assert (pot.price, pot.currency, pot.stock_status, pot.image_url) == (Decimal("33.90"), "USD", "in_stock", "https://img.test/teapot.png")
    assert (cup.title, cup.category, cup.external_id, cup.image_url) == ("Café cup", "Uncategorized", "620", "https://cdn.shopify.com/cup.png")
    assert (cup.price, cup.currency, cup.stock_status) == (Decimal("7.10"), "CHF", "out_of_stock")


def test_listing_html(spark):
    html = """<div id=list><article class="card"><a href="/p/1"><h3>One &amp; only</h3></a><b class="p">€12,50</b><img src="/1.png"><i data-s>In stock</i></article>
    <article class="card"><a href="../p/2">Two<br>lines</a><img data-src="2.png"></article><article class=card>no link</article></div>
    <article class="card"><a href="/outside">x</a></article>"""
    rows = spark.createDataFrame([(1, 0, "https://e.com/collections/hot-deals", "https://e.com/shop/", html)],
                                 "competitor_id long, page_ix long, url string, base_url string, html string")
    selectors = {"product_card": "#list article.card", "title": "h3", "price": ".p", "stock": "[data-s]"}
    rows = rows.withColumn("selectors", F.create_map(*[F.lit(x) for kv in selectors.items() for x in kv]))
    out = listing_html.extract_listing_cards(rows).orderBy("item_ix").collect()
    assert [(r.title, r.url, r.image_url, str(r.price), r.currency, r.stock_status, r.category) for r in out] == [
        ("One & only", "https://e.com/p/1", "https://e.com/1.png", "12.50", "EUR", "in_stock", "Hot Deals"),
        ("Two lines", "https://e.com/p/2", "https://e.com/shop/2.png", "None", "USD", "unknown", "Hot Deals")]


def test_sitemaps(spark):
    urls = ["https://example.com/product/mug", " https://www.example.com/products/plate?size=2&amp;set=1 ", "https://elsewhere.test/product/mug",
            "https://example.com/about", "https://example.com/product/mug"]
    body = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls).replace("loc>", "LOC>", 2) + "</urlset>"
    docs = spark.createDataFrame([(1, 1, "https://example.com", body)], "doc_id long, competitor_id long, base_url string, body string")
    assert [r.url for r in sitemaps.sitemap_product_urls(docs).orderBy("pos").collect()] == [
        "https://example.com/product/mug", "https://www.example.com/products/plate?size=2&set=1"]
    links = ["/collections/garden", "/collections/frontpage", "https://example.com/collections/table-ware?page=2", "/collections/garden"]
    docs = spark.createDataFrame([(1, " ".join(f'<a href="{u}">x</a>' for u in links))], "doc_id long, body string")
    assert [r.handle for r in sitemaps.collection_handles(docs).orderBy("pos").collect()] == ["garden", "table-ware"]


def walked(spark, tree):
    docs = spark.createDataFrame([(1, "https://e.com", f"https://e.com/{k}", "".join(f"<loc>https://e.com/{u}</loc>" for u in v)) for k, v in tree.items()],
                                 "competitor_id long, base_url string, doc_url string, body string")
    return [r.url.removeprefix("https://e.com/products/") for r in sitemaps.sitemap_closure(docs).orderBy("trail").collect()]


def test_sitemap_walk_ends_at_leaves_and_in_circles(spark):
    tree = {"sitemap.xml": ["a.xml", "b.xml", "missing.xml"], "a.xml": ["c.xml", "sitemap.xml", "a.xml"], "b.xml": ["products/3", "d.xml"],
            "c.xml": ["products/1", "products/2"], "d.xml": ["products/never"]}
    assert sorted(walked(spark, tree)) == ["1", "2", "3"]


def test_sitemap_walk_has_no_limits(spark):
    """Twelve nested documents, a child shared by all of them, and a chain of many levels."""
    tree = {"sitemap.xml": [f"n{i}.xml" for i in range(12)] + ["deep0.xml"], "shared.xml": ["products/shared"]}
    tree |= {f"n{i}.xml": ["shared.xml", f"own{i}.xml"] for i in range(12)} | {f"own{i}.xml": [f"products/{i}"] for i in range(12)}
    tree |= {f"deep{i}.xml": [f"deep{i + 1}.xml"] for i in range(6)} | {"deep6.xml": ["products/deep"]}
    assert sorted(walked(spark, tree)) == sorted([*map(str, range(12)), "shared", "deep"])


def test_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"products": [\n{"id": 1, "title": "T", "handle": "h",\n "variants": [{"price": "2"}]}]}')
    docs = read_documents(spark, str(tmp_path)).select(F.lit(1).alias("competitor_id"), F.lit("https://e.com").alias("base_url"),
                                                      F.lit(None).cast("string").alias("category"), F.lit(0).alias("page_ix"), "body")
    assert [(r.title, str(r.price)) for r in catalogs.extract_catalog_json(docs).collect()] == [("T", "2.00")]


def test_take_pages_edges(spark):
    rows = [("a", 1, True, 5), ("a", 2, True, 5), ("a", 4, True, 5), ("b", 1, False, 5), ("b", 2, True, 5), ("c", 1, True, 0), ("d", 2, True, 1),
            *[("e", n, True, 1) for n in range(1, 9)], ("a", 2, True, 5)]
    pages_ = spark.createDataFrame(rows, "target string, page_no int, ok boolean, n_products int")
    out = sorted({(r.target, r.page_no) for r in targets.take_pages(pages_, ["target"]).collect()})
    assert out == [("a", 1), ("a", 2), *[("e", n) for n in range(1, 9)]]
    limited = {(r.target, r.page_no) for r in targets.take_pages(pages_, ["target"], max_pages=5).collect()}
    assert limited == {("a", 1), ("a", 2), *[("e", n) for n in range(1, 6)]}


def test_category_ids_of_late_pages(spark):
    shops = spark.createDataFrame([(1, [], {})], "id long, listing_urls array<string>, selector_config map<string,string>")
    landed = spark.createDataFrame([(1, 2**30, '<a href="/x/c5"></a>'), (1, 2**23, '<a href="/x/c9"></a>')], "competitor_id long, page_ix long, html string")
    assert [r.category_id for r in targets.category_ids(shops, landed).orderBy("pos").collect()] == ["9", "5"]


def test_fetch_targets_last_category_wins(spark):
    shops = spark.createDataFrame([(1, "https://e.com/", ["https://e.com/collections/pets/", "https://e.com/products.json", "https://e.com/x"], {}),
                                   (2, "https://f.com", [], {"discover_collections": "false", "include_all_products": "false"})],
                                  "id long, base_url string, listing_urls array<string>, selector_config map<string,string>")
    found = spark.createDataFrame([(1, 0, "pets", "All Pets", 3), (1, 1, "void", "V", 0), (1, 2, "no-title", "", None), (2, 0, "x", "X", 1)],
                                  "competitor_id long, pos long, handle string, title string, products_count int")
    out = [(r.competitor_id, r.url, r.category) for r in targets.fetch_targets(shops, found).orderBy("competitor_id", "ord").collect()]
    assert out == [(1, "https://e.com/collections/pets/products.json", "All Pets"), (1, "https://e.com/products.json", None),
                   (1, "https://e.com/collections/no-title/products.json", "No Title"), (2, "https://f.com/products.json", None)]


def test_dedupe_keeps_first(spark):
    base = pages(spark, [{"products": [{"id": i, "title": f"t{i}", "handle": h, "variants": [{"id": 1, "price": str(i)}]} for i, h in enumerate("aba")]}], category=None)
    out = catalogs.dedupe_catalog(catalogs.extract_catalog_json(base)).orderBy("item_ix").collect()
    assert [r.title for r in out] == ["t0", "t1"]


def test_onboarding(spark):
    schema = "id int, base_url string, scrape_type string, listing_urls array<string>, selector_config map<string,string>"
    both = {"discover_collections": "true", "include_all_products": "true"}
    cases = [  # as given, and the type and settings they get
        (("https://plain.test/", "generic_selector", [], {}), "shopify_json", both),
        (("https://given.test", "shopify_json", [], {"include_all_products": "false", "collection_handles": '["cups"]'}), "shopify_json",
         {**both, "include_all_products": "false", "collection_handles": '["cups"]'}),
        (("https://numbered.test/", "shopify_json", ["https://numbered.test/ar/-/c41207/?page=1"], {}), "salla_json", None),
        (("https://listed.test", "generic_selector", ["https://listed.test/all-items"], {}), "generic_selector", {}),
        ((None, None, None, None), "shopify_json", both),
        (("https://marked.test", "custom", [], {"platform": "salla"}), "salla_json", None),
        (("https://typed.test", "salla_json", [], {}), "salla_json", None),
    ]
    frame = spark.createDataFrame([(i, *given) for i, (given, _, _) in enumerate(cases)], schema)
    for row in onboarding.normalize_competitors(frame).collect():
        given, kind, config = cases[row.id]
        assert row.scrape_type == kind and (config is None or row.selector_config == config)
        assert not given[2] or row.listing_urls == given[2]


def test_seed_defaults(spark):
    defaults = onboarding.default_competitors(spark)
    first = defaults.first()
    stored = spark.createDataFrame([(first.base_url.rstrip("/"),)], "base_url string")
    left = onboarding.seed_competitors(defaults, stored)
    assert left.count() == defaults.count() - 1 and left.where(F.col("name") == first.name).count() == 0


def test_collection_url_problems(spark):
    shops = spark.createDataFrame([(1, "https://www.Shop.com")], "id long, base_url string")
    asked = spark.createDataFrame([(1, " https://shop.com/collections/a "), (1, "/collections/a"), (1, "ftp://shop.com/a"), (1, "https://other.com/a"), (9, "https://shop.com")],
                                  "competitor_id long, collection_url string")
    out = onboarding.check_collection_urls(asked, shops).collect()
    assert sorted(str(r.problem)[:30] for r in out) == ["Collection URL must be an abso", "Collection URL must be an abso", "Collection URL must belong to ", "Competitor not found", "None"]
    assert [r.collection_url for r in onboarding.valid_collection_urls(asked, shops).collect()] == ["https://shop.com/collections/a"]
