"""Exports of landed items: CSV, JSON lines, and one JSON document per collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.constants import EXPORT_FIELDS
from shelfwatch.session import cut_lineage

DOCUMENT = ("competitor_name", "collection_url")


def export_rows(items: DataFrame, competitors: DataFrame, scraped_at) -> DataFrame:
    """The thirteen export columns. `items` carry the collection_url they were requested for.

    The join is told to sort and merge: items parsed out of pages have the size of the pages' file in Spark's statistics, so it would
    broadcast all of them through the driver. Partitions of a large shop are split by AQE.
    """
    shops = competitors.select(
        F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"), F.col("base_url").alias("competitor_base_url")
    )
    filled = items.join(shops.hint("merge"), "competitor_id").withColumns({
        "currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")),
        "stock_status": F.coalesce(F.nullif("stock_status", F.lit("")), F.lit("unknown")),
        "product_url": F.col("url"),
        "scraped_at": F.lit(str(scraped_at)),
    })
    return filled.select(*EXPORT_FIELDS)


def export_order() -> list[Column]:
    """By title without case, then price with missing prices last; url and id settle ties."""
    return [F.lower(F.coalesce("title", F.lit(""))), F.col("price").isNull(), F.col("price"), F.col("product_url"),
            F.coalesce("external_id", F.lit(""))]


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.orderBy(*DOCUMENT, *export_order()).write.mode("overwrite").option("header", True).csv(folder)


def write_jsonl(rows: DataFrame, folder: str) -> None:
    rows.orderBy(*DOCUMENT, *export_order()).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def export_document(rows: DataFrame) -> DataFrame:
    """Lines of one JSON document per competitor and collection: part 0 opens it, part 1 holds the items, part 2 closes it.

    A document has no size limit, so it is never gathered into one value: only its item count and first sort key are
    aggregated, and the lines are put in order by the distributed sort of the writer. The rows are written once, because heads and
    lines both start from them.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(export_order())])
    keyed = cut_lineage(rows).withColumn("sort_key", key)
    heads = cut_lineage(keyed.groupBy(*DOCUMENT).agg(F.count("*").alias("n"), F.min("sort_key").alias("first_key")))
    none = F.lit(None).cast(keyed.schema["sort_key"].dataType).alias("sort_key")
    opening = F.to_json(F.struct(F.col("competitor_name").alias("competitor"), "collection_url", F.col("n").alias("products_count")))
    opened = heads.select(*DOCUMENT, F.lit(0).alias("part"), none, F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"items":[')).alias("line"))
    closed = heads.select(*DOCUMENT, F.lit(2).alias("part"), none, F.lit("]}").alias("line"))
    item = F.to_json(F.struct(*EXPORT_FIELDS), {"ignoreNullFields": "false"})
    comma = F.when(F.col("sort_key") == F.col("first_key"), "").otherwise(",")
    items = keyed.join(heads.drop("n"), list(DOCUMENT)).select(*DOCUMENT, F.lit(1).alias("part"), "sort_key", F.concat(comma, item).alias("line"))
    return opened.unionByName(items).unionByName(closed)


def write_documents(rows: DataFrame, folder: str) -> None:
    """One folder per document whose part files, read in name order, are the document."""
    lines = export_document(rows).withColumn("document", F.md5(F.concat_ws("|", *DOCUMENT)))
    ordered = lines.orderBy("document", "part", "sort_key")
    ordered.select("document", "line").write.mode("overwrite").partitionBy("document").text(folder)
