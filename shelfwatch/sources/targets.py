"""What to fetch, and which of the fetched pages and sources count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions import constants as k
from shelfwatch.functions.text import blank_to_null, category_from_url, title_from_handle
from shelfwatch.functions.urls import path, query, without_slash

# Room for a position (int) behind a kind or a page number (int).
KIND_STRIDE = 1 << 32


def _flag(config: Column, key: str) -> Column:
    """A switch of the config map; on unless it is set to something false."""
    return F.coalesce(~config[key].isin("false", "0", ""), F.lit(True))


def fetch_targets(competitors: DataFrame, collections: DataFrame) -> DataFrame:
    """(competitor_id, url, category, ord): listing urls, discovered collections, then the catch-all catalog.

    `competitors` have id, base_url, listing_urls and selector_config (map, lists as JSON text); `collections` have
    competitor_id, pos, handle, title and products_count. A url named twice keeps its first place and its last category.
    """
    base = competitors.select(
        F.col("id").alias("competitor_id"), without_slash(F.col("base_url")).alias("base"), "listing_urls",
        F.coalesce("selector_config", F.create_map().cast("map<string,string>")).alias("config"),
    )
    listed = base.select("competitor_id", F.posexplode("listing_urls").alias("pos", "listing"))
    is_collection = F.col("listing").contains("/collections/")
    listed = listed.where(is_collection | F.col("listing").endswith("/products.json")).select(
        "competitor_id",
        F.when(is_collection, F.concat(without_slash(F.col("listing")), F.lit("/products.json"))).otherwise(F.col("listing")).alias("url"),
        category_from_url(F.col("listing")).alias("category"), F.col("pos").cast("long").alias("ord"),
    )
    allowed = F.from_json(F.col("config")["collection_handles"], "array<string>")
    any_allowed = F.coalesce(F.size(allowed), F.lit(0)) > 0
    found = (
        collections.where("handle <> ''").join(base, "competitor_id").where(_flag(F.col("config"), "discover_collections"))
        .where(~any_allowed | F.array_contains(allowed, F.col("handle")))
        .where("products_count is null or products_count <> 0")
        .select(
            "competitor_id", F.concat("base", F.lit("/collections/"), "handle", F.lit("/products.json")).alias("url"),
            F.coalesce(blank_to_null(F.col("title")), title_from_handle(F.col("handle"))).alias("category"),
            (F.col("pos") + KIND_STRIDE).alias("ord"),
        )
    )
    catch_all = base.select(
        "competitor_id", F.concat("base", F.lit("/products.json")).alias("url"), F.lit(None).cast("string").alias("category"),
        F.lit(2 * KIND_STRIDE).alias("ord"), "config",
    )
    wanted = catch_all.where(_flag(F.col("config"), "include_all_products")).drop("config")
    named = listed.unionByName(found).unionByName(wanted)
    # A competitor left without any target falls back to its whole catalog.
    bare = catch_all.drop("config").join(named.select("competitor_id"), "competitor_id", "left_anti")
    return named.unionByName(bare).groupBy("competitor_id", "url").agg(
        F.max_by("category", "ord").alias("category"), F.min("ord").alias("ord")
    )


def take_pages(pages: DataFrame, keys: list[str], max_pages: int | None = None) -> DataFrame:
    """Pages 1, 2, .. of each target up to the first that is missing, failed or empty, and up to `max_pages` where it is given.

    `pages` have the key columns, page_no, ok and n_products. Good page numbers without a gap equal their rank, so the pages of a target
    are numbered; a target's pages are one listing's.
    """
    good = pages.where("ok and n_products > 0 and page_no >= 1")
    if max_pages is not None:
        good = good.where(F.col("page_no") <= max_pages)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("page_no"))
    return good.withColumn("rank", rank).where("page_no = rank").drop("rank")


def source_fallback(items: DataFrame) -> DataFrame:
    """Items of each competitor's best source only (smallest source_rank that delivered anything)."""
    best = items.groupBy("competitor_id").agg(F.min("source_rank").alias("source_rank"))
    return items.join(best, ["competitor_id", "source_rank"])


def category_id_from_url(url: Column) -> Column:
    """Category number of a path ending in `/c<digits>`, else of the known query keys."""
    decoded = F.coalesce(F.try_url_decode(query(url)), query(url))

    def value(key):
        return F.regexp_extract(decoded, rf"(?:^|&){key}=([^&]+)", 1)

    keys = [value("source_value"), value(r"source_value\[\]"), value("category_id")]
    return F.coalesce(
        blank_to_null(F.regexp_extract(path(url), r"/c(\d+)/?$", 1)), *[F.when(v.rlike(r"^\d+$"), v) for v in keys]
    )


def category_ids_from_html(html: Column) -> Column:
    """Category numbers of list elements, then of links, distinct in that order."""
    found = F.concat(
        F.regexp_extract_all(html, F.lit("(?i)" + k.CATEGORY_ELEMENT), F.lit(1)),
        F.regexp_extract_all(html, F.lit(k.CATEGORY_PATH), F.lit(1)),
    )
    return F.array_distinct(found)


def category_ids(competitors: DataFrame, landed: DataFrame) -> DataFrame:
    """(competitor_id, pos, category_id): configured ids and ids of listing urls, else ids in the landed pages.

    `landed` has competitor_id, page_ix and html of the listing pages.
    """
    config = F.coalesce(F.col("selector_config"), F.create_map().cast("map<string,string>"))
    raw = F.coalesce(blank_to_null(config["category_ids"]), blank_to_null(config["category_id"]))
    configured = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.when(raw.isNotNull(), F.array(raw)),
                            F.array().cast("array<string>"))
    from_urls = F.array_compact(F.transform(F.coalesce("listing_urls", F.array().cast("array<string>")), category_id_from_url))
    ids = F.array_distinct(F.filter(F.transform(F.concat(configured, from_urls), lambda i: F.trim(i)), lambda i: i != ""))
    own = competitors.select(F.col("id").alias("competitor_id"), ids.alias("ids"))
    direct = own.where(F.size("ids") > 0).select("competitor_id", F.posexplode("ids").alias("pos", "category_id"))
    silent = own.where(F.size("ids") == 0).select("competitor_id")
    found = (
        landed.join(silent, "competitor_id", "left_semi")
        .select("competitor_id", "page_ix", F.posexplode(category_ids_from_html(F.col("html"))).alias("pos", "category_id"))
        .groupBy("competitor_id", "category_id").agg(F.min(F.col("page_ix").cast("long") * KIND_STRIDE + F.col("pos")).alias("pos"))
    )
    return direct.select("competitor_id", F.col("pos").cast("long").alias("pos"), "category_id").unionByName(
        found.select("competitor_id", "pos", "category_id")
    )
