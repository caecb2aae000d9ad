"""List endpoints: optional filters, documented sort orders, pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.text import first_filled
from shelfwatch.session import at
from shelfwatch.sources.tables import with_competitor

# Null placement is spelled out: ascending puts nulls last, descending puts them first.
PRODUCT_SORTS = {
    "last_checked_at": "last_checked_at desc nulls first",
    "price_asc": "current_price asc nulls last",
    "price_desc": "current_price desc nulls first",
    "first_seen": "first_seen_at desc nulls first",
    "title": "title asc nulls last",
}


def sort_columns(sort: str) -> list[Column]:
    """One of five orders; an unknown name falls back to the newest check. The id breaks ties."""
    name, direction, _, nulls = PRODUCT_SORTS.get(sort, PRODUCT_SORTS["last_checked_at"]).split()
    return [getattr(F.col(name), f"{direction}_nulls_{nulls}")(), F.col("id").asc()]


def first_page(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page with its position in the whole order.

    The limit runs as a distributed top-k; only the rows of the page reach the single-partition numbering.
    """
    skip = (page - 1) * page_size
    rows = df.orderBy(*order).offset(skip).limit(page_size) if skip else df.orderBy(*order).limit(page_size)
    return rows.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) + skip).cast("long"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def product_list(
    products: DataFrame, competitors: DataFrame, *, competitor_id=None, category=None, search=None, active=None,
    stock_status=None, min_price=None, max_price=None, date_from=None, date_to=None,
) -> DataFrame:
    """Products that pass every given filter, with the competitor's name. Bounds are inclusive."""
    rows = products
    if competitor_id is not None:
        rows = rows.where(F.col("competitor_id") == competitor_id)
    if active is not None:
        rows = rows.where(F.col("active") == active)
    if category:
        rows = rows.where(F.col("category") == category)
    if stock_status:
        rows = rows.where(F.col("stock_status") == stock_status)
    if min_price is not None:
        rows = rows.where(F.col("current_price") >= min_price)
    if max_price is not None:
        rows = rows.where(F.col("current_price") <= max_price)
    if date_from:
        rows = rows.where(F.col("first_seen_at") >= at(rows, "first_seen_at", date_from))
    if date_to:
        rows = rows.where(F.col("first_seen_at") <= at(rows, "first_seen_at", date_to))
    if search:
        # Literal text: `%` and `_` are no wildcards here.
        rows = rows.where(F.contains("normalized_title", F.lit(search.lower())))
    return with_competitor(rows, competitors)


def product_page(rows: DataFrame, sort: str = "last_checked_at", page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of the product list in the named order."""
    return first_page(rows, sort_columns(sort), page, page_size)


def product_page_after(rows: DataFrame, after, sort: str = "last_checked_at", page_size: int = 50) -> DataFrame:
    """The page that follows the row `after` (a mapping with the sort's column and `id`) in the named order.

    Everything up to that row is filtered out, so a page deep in the list costs what the first one costs: every task keeps `page_size` rows.
    """
    name, direction, _, nulls = PRODUCT_SORTS.get(sort, PRODUCT_SORTS["last_checked_at"]).split()
    column, later_id = F.col(name), F.col("id") > after["id"]
    if after[name] is None:
        behind = column.isNull() & later_id
        if nulls == "first":
            behind |= column.isNotNull()
    else:
        value = F.lit(after[name])
        behind = (column > value if direction == "asc" else column < value) | ((column == value) & later_id)
        if nulls == "last":
            behind |= column.isNull()
    return rows.where(behind).orderBy(*sort_columns(sort)).limit(page_size)


def product_lookup(products: DataFrame, competitors: DataFrame, ids: DataFrame | list) -> DataFrame:
    """Products by id with the competitor's name; `ids` is a short list or a frame with column `id`."""
    if isinstance(ids, DataFrame):
        rows = products.join(ids.select("id"), "id", "left_semi")
    else:
        rows = products.where(F.col("id").isin(*ids))
    return with_competitor(rows, competitors)


def product_history(snapshots: DataFrame, product_id=None) -> DataFrame:
    """Snapshots oldest first, of one product or of all of them."""
    rows = snapshots if product_id is None else snapshots.where(F.col("product_id") == product_id)
    return rows.orderBy("product_id", "checked_at")


def price_extremes(snapshots: DataFrame) -> DataFrame:
    """All-time low and high of the non-zero prices, for products with at least two snapshots."""
    price = F.when(F.col("price") != 0, F.col("price"))
    return (
        snapshots.groupBy("product_id")
        .agg(F.count("*").alias("n_snapshots"), F.min(price).alias("low"), F.max(price).alias("high"))
        .where("n_snapshots >= 2")
    )


def price_series(snapshots: DataFrame) -> DataFrame:
    """Plottable points (day, price) of the products that have at least two of them."""
    points = snapshots.where("price is not null and price <> 0").select(
        "product_id", F.to_date("checked_at").alias("day"), "checked_at", "price"
    )
    # Counted apart from the rows: the count combines on the map side, a window would gather each product in one task.
    enough = points.groupBy("product_id").agg(F.count("*").alias("n")).where("n >= 2").select("product_id")
    return points.join(enough, "product_id", "left_semi")


def product_key(product_id: Column, spread: Column) -> list[Column]:
    """Two-column join key of an optional product id.

    Rows without product get a key of their own that no product has: they neither match nor gather under null, and the
    table is read once.
    """
    return [product_id.isNotNull().alias("has_product"), F.coalesce(product_id, spread).alias("product_key")]


def event_rows(events: DataFrame, competitors: DataFrame, products: DataFrame, *keep: str) -> DataFrame:
    """Events with competitor name and, where the product still exists, its title and category."""
    items = products.select(
        F.lit(True).alias("has_product"), F.col("id").alias("product_key"), F.col("title").alias("product_title"),
        F.col("category").alias("product_category"),
    )
    rows = events.select(
        "id", "competitor_id", "product_id", "event_type", "detected_at", "notification_sent", *keep,
        *product_key(F.col("product_id"), F.col("id")),
    )
    joined = rows.join(items, ["has_product", "product_key"], "left").drop("has_product", "product_key")
    return with_competitor(joined, competitors)


def event_list(
    events: DataFrame, competitors: DataFrame, products: DataFrame, *, event_type=None, competitor_id=None,
    product_id=None, category=None, date_from=None, date_to=None, notification_sent=None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events that pass every given filter. The category filter looks at the product's current category."""
    rows = events
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    if competitor_id is not None:
        rows = rows.where(F.col("competitor_id") == competitor_id)
    if product_id is not None:
        rows = rows.where(F.col("product_id") == product_id)
    if date_from:
        rows = rows.where(F.col("detected_at") >= at(rows, "detected_at", date_from))
    if date_to:
        rows = rows.where(F.col("detected_at") <= at(rows, "detected_at", date_to))
    if notification_sent is not None:
        rows = rows.where(F.col("notification_sent") == notification_sent)
    out = event_rows(rows, competitors, products, *keep)
    return out.where(F.col("product_category") == category) if category else out


def event_category(new_category: Column, old_category: Column, product_category: Column) -> Column:
    """Category shown for an event: the payload's new one, its old one, the product's; empty counts as absent."""
    return first_filled(new_category, old_category, product_category)


def activity_by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("detected_at").alias("day")).agg(F.count("*").alias("n_events"))


def product_events(events: DataFrame, product_ids: DataFrame) -> DataFrame:
    """Events of the given products (column `product_id`)."""
    return events.join(product_ids.select("product_id"), "product_id", "left_semi")
