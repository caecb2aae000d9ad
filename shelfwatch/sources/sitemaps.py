"""Sitemap documents: locations, product urls, collection handles and nested sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import constants as k
from shelfwatch.functions.text import unescape_all
from shelfwatch.functions.urls import netloc, path, site
from shelfwatch.session import cut_lineage


def locs(body: Column) -> Column:
    return unescape_all(F.regexp_extract_all(body, F.lit("(?i)" + k.SITEMAP_LOC), F.lit(1)))


def product_locs(all_locs: Column, base_url: Column) -> Column:
    """Distinct product urls of the shop's own host, in order."""
    ours = F.filter(all_locs, lambda u: (site(u) == site(base_url)) & path(u).rlike("/products?/"))
    return F.array_distinct(ours)


def nested_locs(all_locs: Column, base_url: Column) -> Column:
    """The `.xml` locations on exactly the same host."""
    return F.filter(all_locs, lambda u: u.endswith(".xml") & (netloc(u) == netloc(base_url)))


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """Every location of every document with its position. Distinct and order are per document, so nothing is shuffled."""
    return docs.select("doc_id", F.posexplode(locs(F.col("body"))).alias("pos", "loc"))


def sitemap_product_urls(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", "competitor_id", "base_url", locs(F.col("body")).alias("locs"))
    return found.select("doc_id", "competitor_id", F.posexplode(product_locs(F.col("locs"), F.col("base_url"))).alias("pos", "url"))


def handles(text: Column) -> Column:
    """Distinct collection handles named in a text, first seen first, without the generic ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(k.COLLECTION_PATH), F.lit(1)))
    return F.filter(found, lambda h: ~h.isin(*k.IGNORED_COLLECTIONS))


def collection_handles(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(handles(F.col("body"))).alias("pos", "handle"))


def sitemap_closure(docs: DataFrame) -> DataFrame:
    """Product urls reachable from each shop's `/sitemap.xml`: (competitor_id, url, trail)."""
    found = docs.select("competitor_id", "base_url", "doc_url", locs(F.col("body")).alias("locs"))
    known = found.select(
        "competitor_id", "base_url", "doc_url", product_locs(F.col("locs"), F.col("base_url")).alias("leaves"),
        nested_locs(F.col("locs"), F.col("base_url")).alias("nested"),
    )
    return _walk(known).withColumnRenamed("leaf", "url")


def collection_closure(docs: DataFrame) -> DataFrame:
    """Collection handles reachable from each shop's `/sitemap.xml`: (competitor_id, handle, trail)."""
    known = docs.select(
        "competitor_id", "base_url", "doc_url", handles(F.col("body")).alias("leaves"),
        nested_locs(locs(F.col("body")), F.col("base_url")).alias("nested"),
    )
    return _walk(known).withColumnRenamed("leaf", "handle")


def _walk(known: DataFrame) -> DataFrame:
    """Leaves of the documents reached from the root: (competitor_id, leaf, trail).

    A document with leaves ends the walk, any other passes it on to its nested sitemaps. Each round joins the documents that
    were reached for the first time with the landed ones, until none is new, so a document shared by many is
    entered once and circles end. `trail` is a document's first path, level by level, and orders the results.
    """
    known = cut_lineage(known)
    root = F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/sitemap.xml"))
    step = F.concat("trail", F.lpad(F.col("pos").cast("string"), 10, "0"))
    front = known.where(F.col("doc_url") == root).select("competitor_id", "doc_url", "leaves", "nested", F.lit("").alias("trail"))
    reached = front = cut_lineage(front)
    while not front.isEmpty():
        passed = front.where(F.size("leaves") == 0).select("competitor_id", "trail", F.posexplode("nested").alias("pos", "doc_url"))
        passed = passed.groupBy("competitor_id", "doc_url").agg(F.min(F.concat(step, F.lit("/"))).alias("trail"))
        passed = passed.join(reached.select("competitor_id", "doc_url"), ["competitor_id", "doc_url"], "left_anti")
        front = cut_lineage(passed.join(known.select("competitor_id", "doc_url", "leaves", "nested"), ["competitor_id", "doc_url"]).select(*reached.columns))
        reached = reached.unionByName(front)
    leaves = reached.select("competitor_id", "trail", F.posexplode("leaves").alias("pos", "leaf"))
    return leaves.groupBy("competitor_id", "leaf").agg(F.min(step).alias("trail"))
