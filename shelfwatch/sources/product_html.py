"""Product pages: JSON-LD first, serialized page state as fallback. No shuffle: every page is read on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import constants as k
from shelfwatch.functions.binding import let
from shelfwatch.functions.prices import with_price
from shelfwatch.functions.text import blank_to_null, first_filled, first_matches, strip, unescape, unescape_all
from shelfwatch.functions.urls import resolve_url
from shelfwatch.sources.catalogs import _joined_ids, numeric_tail


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_product(item: Column) -> Column:
    kinds = F.try_variant_get(item, '$["@type"]', "array<string>")
    return F.coalesce(F.array_contains(kinds, "Product"), _text(item, '$["@type"]') == "Product", F.lit(False))


def with_jsonld_product(pages: DataFrame, html: str = "html", name: str = "product") -> DataFrame:
    """`pages` with the first JSON-LD object whose type is or contains Product, as a variant; null when there is none.

    Blocks are read in page order; a block may be an object, a list of objects or a `@graph`.
    """
    blocks = F.transform(F.regexp_extract_all(html, F.lit("(?is)" + k.JSONLD_BLOCK), F.lit(1)), lambda b: strip(b))
    rows = pages.withColumn("_blocks", blocks)
    rows = rows.withColumn("_texts", unescape_all(F.col("_blocks"))).drop("_blocks")

    def members(v):
        return F.coalesce(_list(v, '$["@graph"]'), _list(v, "$"), F.array(v))

    items = F.flatten(F.transform("_texts", lambda text: let(
        F.try_parse_json(text), lambda v: F.coalesce(members(v), F.array().cast("array<variant>"))
    )))
    return rows.withColumn(name, F.get(F.filter(items, _is_product), F.lit(0))).drop("_texts")


STATE = {
    "state_title": k.STATE_TITLE, "state_price": k.STATE_PRICE, "state_currency": k.STATE_CURRENCY, "state_image": k.STATE_IMAGE,
    "state_product": k.STATE_PRODUCT_ID, "state_variant": k.STATE_VARIANT_ID, "state_available": k.STATE_AVAILABLE,
    "state_type": k.STATE_TYPE,
}


def extract_html_products(pages: DataFrame) -> DataFrame:
    """One record per page (competitor_id, item_ix, base_url, url, html) that names a product."""
    p, offer, c = F.col("product"), F.col("offer"), F.col
    rows = with_jsonld_product(pages.select("competitor_id", "item_ix", "base_url", "url", "html"))
    rows = first_matches(rows, "html", STATE).withColumn(
        "offer", F.coalesce(F.get(_list(p, "$.offers"), F.lit(0)), F.try_variant_get(p, "$.offers", "variant"))
    )
    rows = rows.withColumns({
        "sku": _text(p, "$.sku"),
        "raw_title": strip(first_filled(_text(p, "$.name"), c("state_title"))),
        "raw_price": first_filled(_text(offer, "$.price"), c("state_price")),
        "raw_currency": F.coalesce(first_filled(_text(offer, "$.priceCurrency"), c("state_currency")), F.lit("USD")),
        "image_url": first_filled(
            F.coalesce(F.try_variant_get(p, "$.image[0]", "string"), _text(p, "$.image")), c("state_image")
        ),
        "availability": F.lower(F.coalesce(_text(offer, "$.availability"), F.lit(""))),
        "raw_category": F.coalesce(
            first_filled(F.coalesce(_text(p, "$.brand.name"), _plain_text(p, "$.brand")), c("state_type")), F.lit("Uncategorized")
        ),
    }).drop("product", "offer")
    flag = F.coalesce(F.lower("state_available"), F.lit(""))
    stock = (
        F.when(c("availability").contains("outofstock") | flag.isin("!1", "false"), "out_of_stock")
        .when(c("availability").contains("instock") | flag.isin("!0", "true"), "in_stock")
        .otherwise("unknown")
    )
    record = F.struct(
        "competitor_id", "item_ix", resolve_url(c("url"), c("base_url")).alias("url"),
        _joined_ids(c("state_product"), first_filled(c("state_variant"), numeric_tail(c("sku")))).alias("external_id"),
        c("raw_title").alias("title"), "raw_price", "raw_currency", stock.alias("stock_status"), "sku", "image_url",
        c("raw_category").alias("category"),
    )
    # Exploding nothing drops a page without title. A filter would be pushed down and parse every page a second time.
    named = rows.select(F.explode(F.when(c("raw_title") != "", F.array(record))).alias("r")).select("r.*")
    return with_price(named, c("raw_price"), c("raw_currency")).select(
        "competitor_id", "item_ix", "url", "external_id", unescape(c("title")).alias("title"), "price", "currency",
        "stock_status", "sku", "image_url", unescape(c("category")).alias("category"),
    )


def _plain_text(v: Column, path: str) -> Column:
    """A string field; an object in its place is not text."""
    text = _text(v, path)
    return F.when(~text.startswith("{") & ~text.startswith("["), text)
