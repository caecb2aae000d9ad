"""Catalog payloads of three JSON dialects to item records.

A page document is parsed and exploded in place, so extraction needs no shuffle. Values are read as text whatever their
JSON type is: a price that is a number on one page and a string on the next does not null the record.
Input columns are competitor_id, base_url, page_ix (order of the page), body, plus those named per dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.constants import ENGLISH_CATEGORIES
from shelfwatch.functions.prices import with_price
from shelfwatch.functions.text import blank_to_null, english_category, english_text, first_filled, strip, title_from_handle
from shelfwatch.functions.urls import resolve_url, without_slash
from shelfwatch.schemas import ITEM_COLUMNS
from shelfwatch.session import cut_lineage

# Room for any position (int) inside a page (int).
PAGE_STRIDE = 1 << 32

CATALOG_SCHEMA = (
    "products array<struct<id:string,title:string,handle:string,vendor:string,product_type:string,"
    "variants:array<map<string,string>>,images:array<struct<src:string>>>>"
)
GRAPHQL_SCHEMA = (
    "data struct<collection:struct<title:string,products:struct<edges:array<struct<node:struct<"
    "id:string,title:string,handle:string,vendor:string,productType:string,"
    "images:struct<edges:array<struct<node:struct<url:string>>>>,"
    "variants:struct<edges:array<struct<node:struct<id:string,sku:string,availableForSale:string,"
    "price:struct<amount:string,currencyCode:string>>>>>>>>>>>"
)
CATEGORY_API_SCHEMA = "data array<map<string,string>>"


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("false", "0", "", "null"), F.lit(False))


def _position(page_ix: str = "page_ix", pos: str = "pos") -> Column:
    return (F.col(page_ix).cast("long") * PAGE_STRIDE + F.col(pos)).alias("item_ix")


def _joined_ids(product: Column, variant: Column) -> Column:
    return F.when(product.isNotNull() & variant.isNotNull(), F.concat_ws(":", product, variant)).otherwise(
        F.coalesce(product, variant)
    )


def extract_catalog_json(pages: DataFrame) -> DataFrame:
    """`products[]` pages; the page's `category` (its collection) beats vendor and product type."""
    parsed = pages.select(
        "competitor_id", "base_url", "category", "page_ix",
        F.posexplode(F.from_json("body", CATALOG_SCHEMA)["products"]).alias("pos", "p"),
    )
    p, c = F.col("p"), F.col
    variant = F.coalesce(F.get(p["variants"], F.lit(0)), F.create_map().cast("map<string,string>"))
    rows = with_price(parsed.withColumns({"variant": variant, "title": strip(p["title"])}), c("variant")["price"], "USD")
    # A missing flag means in stock, an explicit null or false does not.
    available = ~F.map_contains_key("variant", "available") | _truthy(c("variant")["available"])
    product_id, variant_id = p["id"], c("variant")["id"]
    has_variant = F.coalesce(~variant_id.isin("", "0", "false"), F.lit(False))
    return rows.where("title <> '' and p.handle <> ''").select(
        "competitor_id", _position(),
        F.concat(without_slash(c("base_url")), F.lit("/products/"), p["handle"]).alias("url"),
        F.when(has_variant, F.concat(product_id, F.lit(":"), variant_id)).otherwise(product_id).alias("external_id"),
        "title", "price", "currency",
        F.when(available, "in_stock").otherwise("out_of_stock").alias("stock_status"),
        c("variant")["sku"].alias("sku"), F.get(p["images"], F.lit(0))["src"].alias("image_url"),
        F.coalesce(first_filled(c("category"), p["vendor"], p["product_type"]), F.lit("Uncategorized")).alias("category"),
    )


def numeric_tail(gid: Column) -> Column:
    """Trailing digits of a global id, or the whole id when it has none."""
    return F.when(gid.rlike(r"\d+$"), F.regexp_extract(gid, r"(\d+)$", 1)).otherwise(gid)


def extract_graphql_json(pages: DataFrame) -> DataFrame:
    """Collection-connection pages; extra column `handle`. A page without title takes that of an earlier page."""
    parsed = pages.select(
        "competitor_id", "base_url", "handle", "page_ix", F.from_json("body", GRAPHQL_SCHEMA)["data"]["collection"].alias("c")
    )
    nodes = parsed.select(
        "competitor_id", "base_url", "handle", "page_ix", blank_to_null(F.col("c.title")).alias("page_title"),
        F.posexplode("c.products.edges").alias("pos", "edge"),
    ).select("*", F.col("edge.node").alias("n")).drop("edge")

    # Only pages without a title look at earlier ones. The window runs over one short row per page, and what it finds for
    # the untitled pages is joined back; the products themselves are not moved for it.
    order = Window.partitionBy("competitor_id", "handle").orderBy("page_ix")
    titles = parsed.select("competitor_id", "handle", "page_ix", blank_to_null(F.col("c.title")).alias("t"))
    earlier = titles.withColumn("carried", F.last("t", ignorenulls=True).over(order)).where(
        "t is null and carried is not null"
    ).drop("t")
    nodes = nodes.join(earlier, ["competitor_id", "handle", "page_ix"], "left")

    n, c = F.col("n"), F.col
    edges = F.coalesce(n["variants"]["edges"], F.array().cast("array<struct<node:struct<id:string,sku:string,"
                       "availableForSale:string,price:struct<amount:string,currencyCode:string>>>>"))
    on_sale = F.filter(edges, lambda e: _truthy(e["node"]["availableForSale"]))
    chosen = F.coalesce(F.get(on_sale, F.lit(0)), F.get(edges, F.lit(0)))["node"]
    rows = with_price(
        nodes.withColumns({"v": chosen, "title": strip(n["title"])}), c("v.price.amount"),
        F.coalesce(blank_to_null(c("v.price.currencyCode")), F.lit("USD")),
    )
    collection = F.coalesce("page_title", "carried", title_from_handle(c("handle")))
    return rows.where("title <> '' and n.handle <> ''").select(
        "competitor_id", _position(),
        F.concat(without_slash(c("base_url")), F.lit("/product/"), n["handle"]).alias("url"),
        _joined_ids(numeric_tail(blank_to_null(n["id"])), numeric_tail(blank_to_null(c("v.id")))).alias("external_id"),
        "title", "price", "currency",
        F.when(_truthy(c("v.availableForSale")), "in_stock").otherwise("out_of_stock").alias("stock_status"),
        c("v.sku").alias("sku"), F.get(n["images"]["edges"], F.lit(0))["node"]["url"].alias("image_url"),
        F.coalesce(first_filled(collection, n["productType"], n["vendor"]), F.lit("Uncategorized")).alias("category"),
    )


def _object_or_text(value: Column, key: str) -> Column:
    """`value[key]` when the field is an object, the field itself when it is a string."""
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{key}")).otherwise(value)


def extract_category_api_json(pages: DataFrame) -> DataFrame:
    """`data[]` pages of category APIs; extra columns category_id, currency (requested) and category_name (may be null).

    Unless a name is given, the first product of a category names the category of all its products.
    """
    raw = pages.select(
        "competitor_id", "base_url", "category_id", F.col("currency").alias("requested"), "category_name", "page_ix",
        F.posexplode(F.from_json("body", CATEGORY_API_SCHEMA)["data"]).alias("pos", "r"),
    )
    r, c = F.col("r"), F.col
    currency = F.coalesce(first_filled(c("requested"), r["currency"]), F.lit("USD"))
    rows = with_price(raw, r["price"], currency).select(
        "*", english_text(F.coalesce(first_filled(r["name"], r["title"]), F.lit(""))).alias("title"),
        first_filled(r["url"], r["custom_url"]).alias("product_url"), _position(),
        F.coalesce(english_category(first_filled(c("category_name"), _object_or_text(r["category"], "name")), ENGLISH_CATEGORIES),
                   F.lit("Uncategorized")).alias("own_category"),
    ).where("title <> '' and product_url is not null")

    # The first product of a category is found among all of its records, so they are extracted once and kept.
    rows = cut_lineage(rows.select("competitor_id", "base_url", "category_id", "category_name", "item_ix", "title", "product_url",
                                   "price", "currency", "own_category", "r"))
    group = ["competitor_id", "category_id"]
    first = rows.groupBy(*group).agg(
        F.min_by("own_category", "item_ix").alias("first_category"), F.min("item_ix").alias("first_ix")
    )
    named = rows.join(first, group)
    carried = F.coalesce(english_category(c("first_category"), ENGLISH_CATEGORIES), F.lit("Uncategorized"))
    category = F.when(c("category_name").isNotNull() & (c("category_name") != ""), c("own_category")).when(
        c("item_ix") == c("first_ix"), c("own_category")
    ).otherwise(carried)
    image = first_filled(_object_or_text(r["image"], "url"), r["original_image"])
    out = (r["is_out_of_stock"] == "true") | (r["is_available"] == "false")
    return named.select(
        "competitor_id", "item_ix", resolve_url(c("product_url"), c("base_url")).alias("url"), r["id"].alias("external_id"),
        "title", "price", "currency",
        F.when(out, "out_of_stock").when((r["is_available"] == "true") | (r["status"] == "sale"), "in_stock")
        .otherwise("unknown").alias("stock_status"),
        r["sku"].alias("sku"), resolve_url(image, c("base_url")).alias("image_url"), category.alias("category"),
    )


def dedupe_catalog(items: DataFrame, by_external_id: bool = False) -> DataFrame:
    """First item in order per competitor and key: the url, or the external id where there is one.

    An aggregate, not a window: copies are dropped before the shuffle, so a key holding a large share of the rows
    arrives as one row per input partition.
    """
    key = F.coalesce(blank_to_null(F.col("external_id")), F.col("url")) if by_external_id else F.col("url")
    rest = [n for n in ITEM_COLUMNS if n != "competitor_id"]
    return (
        items.where("url <> ''")
        .groupBy("competitor_id", key.alias("catalog_key"))
        .agg(F.min_by(F.struct(*rest), "item_ix").alias("i"))
        .select("competitor_id", "i.*")
    )
