"""Competitor records: normalising, seeding and checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.constants import CATALOG_CONFIG, DEFAULT_COMPETITORS
from shelfwatch.functions.urls import netloc, scheme, site, without_slash


def normalize_competitors(competitors: DataFrame) -> DataFrame:
    """Infer scrape_type from urls and config, and complete the catalog config; the user's own keys win."""
    c = F.col
    empty_map, empty_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    rows = competitors.withColumns({
        "listing_urls": F.coalesce("listing_urls", empty_list), "selector_config": F.coalesce("selector_config", empty_map)
    })
    config = c("selector_config")

    def filled(key):
        return F.coalesce(~config[key].isin("", "[]"), F.lit(False))

    def category_url(url):
        tail = F.regexp_extract(url, r"^.*/c(.*)$", 1)
        return url.contains("/api/v1/products") | tail.rlike("[0-9]")

    urls = F.concat(F.array(F.coalesce("base_url", F.lit(""))), c("listing_urls"))
    category_api = (
        F.coalesce(config["platform"] == "salla", F.lit(False)) | filled("category_id") | filled("category_ids")
        | F.exists(urls, category_url)
    )
    kind = F.coalesce("scrape_type", F.lit(""))
    no_listing = F.size("listing_urls") == 0
    to_category_api = (kind != "salla_json") & category_api
    to_catalog = ~to_category_api & ((kind == "") | (kind.isin("generic_selector", "custom") & no_listing))
    completed = to_catalog | (~to_category_api & (kind == "shopify_json"))
    defaults = F.create_map(*[F.lit(x) for pair in CATALOG_CONFIG.items() for x in pair])
    missing = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(config, key))
    return rows.withColumns({
        "scrape_type": F.when(to_category_api, "salla_json").when(to_catalog, "shopify_json").otherwise(c("scrape_type")),
        "selector_config": F.when(completed, F.map_concat(missing, config)).otherwise(config),
        "listing_urls": F.when(to_catalog, empty_list).otherwise(c("listing_urls")),
    })


def default_competitors(spark: SparkSession) -> DataFrame:
    """The starter shops."""
    rows = spark.createDataFrame(list(DEFAULT_COMPETITORS), "name string, base_url string")
    return rows.select(
        "name", "base_url", F.lit("Roblox marketplace").alias("category"), F.lit(True).alias("active"),
        F.lit(60).alias("scan_frequency_minutes"), F.lit("shopify_json").alias("scrape_type"),
        F.array().cast("array<string>").alias("listing_urls"),
        F.create_map(*[F.lit(x) for pair in CATALOG_CONFIG.items() for x in pair]).alias("selector_config"),
        F.lit("Starter Shopify competitor. Collections are detected as categories.").alias("notes"),
    )


def seed_competitors(defaults: DataFrame, existing: DataFrame) -> DataFrame:
    """Defaults whose base url, up to trailing slashes, is not stored yet."""
    keyed = defaults.withColumn("seed_key", without_slash(F.col("base_url")))
    stored = existing.select(without_slash(F.col("base_url")).alias("seed_key"))
    return keyed.join(stored, "seed_key", "left_anti").drop("seed_key")


def check_collection_urls(requests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Export requests (competitor_id, collection_url) with `problem`, null when the url may be exported.

    The url must be an absolute http(s) url on the competitor's host.
    """
    bases = competitors.select(F.col("id").alias("competitor_id"), F.col("base_url").alias("competitor_base_url"))
    url = F.trim("collection_url")
    absolute = scheme(url).isin("http", "https") & (netloc(url) != "")
    base = F.col("competitor_base_url")
    problem = (
        F.when(base.isNull(), "Competitor not found")
        .when(~absolute, "Collection URL must be an absolute http(s) URL")
        .when((site(base) != "") & (site(url) != site(base)), "Collection URL must belong to the selected competitor")
    )
    return requests.join(bases, "competitor_id", "left").select("competitor_id", url.alias("collection_url"), problem.alias("problem"))


def valid_collection_urls(requests: DataFrame, competitors: DataFrame) -> DataFrame:
    return check_collection_urls(requests, competitors).where("problem is null").drop("problem")
