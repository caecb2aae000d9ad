"""Normalisation jobs over landed texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.prices import with_price
from shelfwatch.functions.stock import classify_stock
from shelfwatch.functions.text import normalize_title
from shelfwatch.functions.urls import netloc, resolve_url


def parse_prices(texts: DataFrame, default_currency: str = "USD") -> DataFrame:
    """(id, raw) with price and currency."""
    return with_price(texts, F.col("raw"), default_currency).select("id", "raw", "price", "currency")


def price_rejects(parsed: DataFrame) -> DataFrame:
    """Texts per currency, and how many of them held no usable price."""
    return parsed.groupBy("currency").agg(
        F.count("*").alias("n_texts"), F.count_if(F.col("price").isNull()).alias("n_rejected")
    )


def normalize_titles(titles: DataFrame, column: str) -> DataFrame:
    return titles.withColumn("normalized", normalize_title(F.col(column)))


def classify_stock_texts(texts: DataFrame) -> DataFrame:
    return texts.withColumn("stock_status", classify_stock(F.col("raw")))


def stock_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("source", "stock_status").agg(F.count("*").alias("n"))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute links of every page (page_id, url, html). Distinct inside the page: no shuffle."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    links = pages.select("page_id", F.array_distinct(F.transform(hrefs, lambda h: resolve_url(h, F.col("url")))).alias("links"))
    return links.select("page_id", F.explode("links").alias("link"))


def links_per_host(links: DataFrame) -> DataFrame:
    return links.groupBy(F.lower(netloc(F.col("link"))).alias("host")).agg(
        F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages")
    )
