"""One scan batch of any number of competitors against the stored catalog.

The stored row of a product and the scanned items matched to it form one sequence, the stored row first. Price, stock,
title, url and category changes are differences between neighbours of that sequence; the last row is the new state; a
sequence without items is a product that was not seen. So after matching there is a single shuffle, on the product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.constants import MISSES_UNTIL_REMOVED
from shelfwatch.functions.text import blank_to_null, normalize_title
from shelfwatch.schemas import ITEM_COLUMNS, STATE_COLUMNS
from shelfwatch.session import cut_lineage, tasks_for


#: Rows that one task joins or orders.
ROWS_PER_TASK = 100_000

EVENT_COLUMNS = ("competitor_id", "product_id", "item_ix", "event_type", "old_value", "new_value", "event_message", "detected_at")

#: What the columns of an output are made of, beside those of its rows, where that is little; other columns need the whole sequence.
MADE_OF = {
    "events": {
        "competitor_id": (), "product_id": (), "item_ix": (), "detected_at": (), "event_type": ("price", "old_price", "stock_status"),
        "": ("is_new", "price_changed", "stock_changed", "is_removed"),
    },
    "state": {"competitor_id": (), "product_id": (), "active": ("is_removed",), "": ("is_last",)},
}


# --- matching ----------------------------------------------------------------------------------------------

def match_catalog(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with `by_url` and `by_external`: the stored product of the same competitor, or null. Never by title.

    Two equi-joins, not one join with OR, and neither broadcasts the catalog, which is far larger than its file. Items already matched by url, or without url or external id, get a join key
    that exists nowhere, so they spread over all partitions and do not pile up under null.
    """
    return _matched(items.where("length(url) > 0"), state)


def _matched(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with `by_url` and `by_external`; both sides are dealt by key to tasks of `ROWS_PER_TASK` rows before they are aggregated and joined."""
    items = cut_lineage(items)  # landed items are parsed once, not again to count them
    tasks = tasks_for(items, ROWS_PER_TASK, state)
    by_url = state.where("url <> ''").select("competitor_id", F.concat(F.lit("="), "url").alias("url_key"), F.col("product_id").alias("by_url"))
    by_external = _stored_external(state, "match_key")
    keyed = items.withColumn("url_key", _match_key(F.lit(True), F.col("url"), F.col("item_ix")))
    keyed = _with_largest(keyed, by_url, "url_key", "by_url", tasks).withColumn(
        "match_key", _match_key(F.col("by_url").isNull(), F.col("external_id"), F.col("item_ix"))
    )
    return _with_largest(keyed, by_external, "match_key", "by_external", tasks).drop("url_key", "match_key")


def _with_largest(rows: DataFrame, found: DataFrame, key: str, value: str, tasks: int) -> DataFrame:
    """`rows` with the largest `value` that `found` has under their competitor and `key`, or null."""
    keys = ["competitor_id", key]
    largest = found.repartition(tasks, *keys).groupBy(*keys).agg(F.max(value).alias(value))
    return rows.repartition(tasks, *keys).join(largest.hint("merge"), keys, "left")


def _stored_external(state: DataFrame, key: str) -> DataFrame:
    return state.where("external_id <> ''").select(
        "competitor_id", F.concat(F.lit("="), "external_id").alias(key), F.col("product_id").alias("by_external")
    )


def _match_key(wanted: Column, value: Column, spread: Column) -> Column:
    return F.when(wanted & (value != ""), F.concat(F.lit("="), value)).otherwise(F.concat(F.lit("-"), spread.cast("string")))


def first_of_each_product(loose: DataFrame) -> DataFrame:
    """Which unmatched items open a new product: (competitor_id, url, external_id, item_ix).

    In item order, an item opens a product unless an earlier opener has its url or its external id. That greedy rule is
    resolved in rounds: an item that comes first both for its url and for its external id is an opener, and whatever
    shares a key with an opener is settled. A batch with one url per external id needs one round.
    """
    by_url, by_external = ["competitor_id", "url"], ["competitor_id", "external_id"]
    loose = loose.select("competitor_id", "url", blank_to_null(F.col("external_id")).alias("external_id"), "item_ix")
    tasks = tasks_for(loose, ROWS_PER_TASK)
    pairs = loose.repartition(tasks, *by_url).groupBy(*by_url, "external_id").agg(F.min("item_ix").alias("item_ix"))
    openers = None
    while True:
        pairs = cut_lineage(pairs)
        tasks = tasks_for(pairs, ROWS_PER_TASK)
        dealt = pairs.repartition(tasks, *by_url)
        first_url = dealt.groupBy(*by_url).agg(F.min("item_ix").alias("first_url"))
        named = pairs.where("external_id is not null").select(*by_external, "item_ix").repartition(tasks, *by_external)
        first_external = named.groupBy(*by_external).agg(F.min("item_ix").alias("first_external"))
        first = dealt.join(first_url.hint("merge"), by_url).where("item_ix = first_url").select(*by_url, "external_id", "item_ix")
        first_named = first.where("external_id is not null").repartition(tasks, *by_external)
        found = first.where("external_id is null").unionByName(
            first_named.join(first_external.hint("merge"), by_external).where("item_ix = first_external").select(*first.columns)
        )
        found = cut_lineage(found)
        openers = found if openers is None else openers.unionByName(found)
        # Pairs without external id get a join key that exists nowhere.
        taken = found.where("external_id is not null").select("competitor_id", F.concat(F.lit("="), "external_id").alias("external_key"))
        rest = dealt.join(found.select(*by_url).repartition(tasks, *by_url).hint("merge"), by_url, "left_anti")
        rest = rest.withColumn("external_key", _match_key(F.lit(True), F.col("external_id"), F.col("item_ix")))
        keys = ["competitor_id", "external_key"]
        rest = rest.repartition(tasks, *keys).join(taken.repartition(tasks, *keys).hint("merge"), keys, "left_anti").select(*pairs.columns)
        if rest.isEmpty():
            return openers
        pairs = rest


def assign_products(items: DataFrame, state: DataFrame, now) -> DataFrame:
    """Items (with an url) with `product_id`: a stored product, or one opened by an earlier (or this) item of the batch.

    What an item finds depends on its url and external id, and on its place only where the product must have been opened by then. So products are
    looked up once per pair of the two, in rows of nothing else, and the items themselves are shuffled once, to what their pair has found.

    The stored indexes are those of the start of the scan; a product opened in the batch is found at once.
    """
    pairs, found = _found_by_pair(items, state, now)
    keys = ["competitor_id", "url", "external_key"]
    external_key = F.coalesce(F.concat(F.lit("="), blank_to_null(F.col("external_id"))), F.lit(""))
    tasks = tasks_for(items, ROWS_PER_TASK, pairs)
    found = found.withColumn("external_key", external_key).drop("external_id", "item_ix").repartition(tasks, *keys)
    joined = items.withColumn("external_key", external_key).repartition(tasks, *keys).join(found.hint("merge"), keys, "left")
    return joined.withColumn(
        "product_id",
        F.coalesce(
            "by_url",
            F.when(F.col("url_ix") <= F.col("item_ix"), F.col("new_by_url")),
            "by_external",
            F.when(F.col("external_ix") <= F.col("item_ix"), F.col("new_by_external")),
        ),
    ).select("product_id", *ITEM_COLUMNS)


def _found_by_pair(items: DataFrame, state: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The distinct (competitor_id, url, external_id) of the items, and the same with what they find: `by_url` and `by_external` in the stored
    catalog, and of the batch `new_by_url` and `new_by_external` from the items `url_ix` and `external_ix` on.

    Only pairs that a step leaves open go into the next one.
    """
    by_url, pair = ["competitor_id", "url"], ["competitor_id", "url", "external_id"]
    tasks = tasks_for(items, ROWS_PER_TASK, state)
    pairs = items.select(*by_url, blank_to_null(F.col("external_id")).alias("external_id"), "item_ix").repartition(tasks, *by_url)
    pairs = pairs.groupBy(*pair).agg(F.min("item_ix").alias("item_ix"))
    stored_urls = state.where("url <> ''").select(*by_url, F.col("product_id").alias("by_url"))
    pairs = cut_lineage(_with_largest(pairs, stored_urls, "url", "by_url", tasks))
    rest = pairs.where("by_url is null").withColumn("external_key", _match_key(F.lit(True), F.col("external_id"), F.col("item_ix")))
    stored_ids = _stored_external(state, "external_key")
    rest = cut_lineage(_with_largest(rest, stored_ids, "external_key", "by_external", tasks_for(rest, ROWS_PER_TASK, stored_ids)))
    opened = first_of_each_product(rest.where("by_external is null")).withColumn(
        "new_id", F.md5(F.concat_ws("|", F.col("competitor_id").cast("string"), "url", F.lit(str(now))))
    )
    new_url = opened.select(*by_url, F.col("new_id").alias("new_by_url"), F.col("item_ix").alias("url_ix"))
    new_external = opened.where("external_id is not null").select(
        "competitor_id", F.concat(F.lit("="), "external_id").alias("external_key"),
        F.col("new_id").alias("new_by_external"), F.col("item_ix").alias("external_ix"),
    )
    rest = rest.withColumn("external_key", _match_key(F.col("by_external").isNull(), F.col("external_id"), F.col("item_ix")))
    tasks = tasks_for(rest, ROWS_PER_TASK, opened)
    for new, key in ((new_url, "url"), (new_external, "external_key")):
        keys = ["competitor_id", key]
        rest = rest.repartition(tasks, *keys).join(new.repartition(tasks, *keys).hint("merge"), keys, "left")
    return pairs, pairs.where("by_url is not null").unionByName(rest.drop("external_key"), allowMissingColumns=True)


# --- guard -------------------------------------------------------------------------------------------------

def split_scans(scans: DataFrame, items: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Scans (competitor_id, allow_empty) with `products_found` and `accepted`.

    An empty scan must be allowed, and a scan with an error in `errors` (competitor_id) is never accepted, whatever it delivered.
    """
    found = items.groupBy("competitor_id").agg(F.count("*").alias("products_found"))
    rows = scans.join(found, "competitor_id", "left").withColumn("broken", F.lit(False))
    if errors is not None:
        broken = errors.select("competitor_id").distinct().withColumn("is_broken", F.lit(True))
        rows = rows.join(broken, "competitor_id", "left").withColumn("broken", F.coalesce("is_broken", F.lit(False)))
    filled = F.col("products_found").isNotNull() | F.coalesce("allow_empty", F.lit(False))
    return rows.select(
        "competitor_id", F.coalesce("products_found", F.lit(0).cast("long")).alias("products_found"), (filled & ~F.col("broken")).alias("accepted")
    )


def rejected_scans(scans: DataFrame, items: DataFrame) -> DataFrame:
    """Scans that found nothing without being allowed to; their catalogs are left untouched."""
    return split_scans(scans, items).where("not accepted").select("competitor_id")


# --- change sequence ---------------------------------------------------------------------------------------

def change_sequence(state: DataFrame, items: DataFrame, scanned: DataFrame, now) -> DataFrame:
    """Stored rows and items of every product in order, each with its predecessor's values.

    `scanned` (competitor_id) names the accepted scans; other competitors keep their rows and count no miss.

    Products are dealt to tasks by the number of rows, because urls and titles are many times larger in a sort than in a shuffle file.
    """
    tasks = tasks_for(state, ROWS_PER_TASK, items)
    stored = state.join(scanned.withColumn("in_scan", F.lit(True)), "competitor_id", "left").select(
        *STATE_COLUMNS, F.lit(-1).cast("long").alias("item_ix"), F.coalesce("in_scan", F.lit(False)).alias("in_scan")
    )
    kinds = {f.name: f.dataType for f in state.schema.fields}
    clock = F.lit(str(now))
    seen = assign_products(items, state, now).select(
        "competitor_id", "product_id", "url", "external_id", "title", normalize_title(F.col("title")).alias("normalized_title"),
        "category", "image_url", F.col("price").cast("decimal(12,2)").alias("price"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.coalesce("stock_status", F.lit("unknown")).alias("stock_status"), "sku",
        *[clock.cast(kinds[c]).alias(c) for c in ("first_seen_at", "last_seen_at", "last_checked_at")],
        F.lit(True).alias("active"), F.lit(0).cast(kinds["consecutive_misses"]).alias("consecutive_misses"),
        F.col("item_ix").cast("long").alias("item_ix"), F.lit(True).alias("in_scan"),
    )
    whole = Window.partitionBy("competitor_id", "product_id").orderBy("item_ix")
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stored.unionByName(seen)
    rows = rows.repartition(tasks, "competitor_id", "product_id")
    rows = rows.withColumns({
        "is_stored": F.col("item_ix") < 0,
        "is_first": F.row_number().over(whole) == 1,
        "is_last": F.lead("item_ix").over(whole).isNull(),
        "old_price": F.lag("price").over(whole),
        "old_stock": F.lag("stock_status").over(whole),
        "old_title": F.lag("title").over(whole),
        "old_image": F.lag("image_url").over(whole),
        "old_url": F.lag("url").over(whole),
        # An empty category keeps the last one that was not empty.
        "category": F.coalesce(
            F.last(blank_to_null(F.col("category")), ignorenulls=True).over(so_far), F.first("category").over(so_far)
        ),
        "sku": F.first("sku").over(so_far),
        "first_seen_at": F.first("first_seen_at").over(so_far),
    })
    rows = rows.withColumn("price_changed", ~F.col("is_first") & ~F.col("price").eqNullSafe(F.col("old_price")))
    # The stored currency moves only together with the price.
    rows = rows.withColumn("item_currency", F.col("currency")).withColumn(
        "currency",
        F.last(F.when(F.col("is_first") | F.col("price_changed"), F.col("currency")), ignorenulls=True).over(so_far),
    )
    rows = rows.withColumns({
        "old_category": F.lag("category").over(whole),
        "old_currency": F.lag("currency").over(whole),
        "stock_changed": ~F.col("is_first") & (F.col("stock_status") != F.col("old_stock")),
    })

    def moved(column: str, old: str) -> Column:
        return ~F.col(column).eqNullSafe(F.col(old))

    described = moved("title", "old_title") | moved("image_url", "old_image") | moved("url", "old_url")
    missed = F.col("is_stored") & F.col("is_last") & F.col("in_scan") & F.col("active")
    return rows.withColumns({
        "is_new": F.col("is_first") & ~F.col("is_stored"),
        "snapshot_needed": ~F.col("is_stored") & (
            F.col("is_first") | F.col("price_changed") | F.col("stock_changed") | described
            | moved("category", "old_category")
        ),
        "is_missed": missed,
        "is_removed": missed & (F.coalesce("consecutive_misses", F.lit(0)) + 1 >= MISSES_UNTIL_REMOVED),
    })


def price_event_type(old: Column, new: Column) -> Column:
    return F.when(new > old, "price_increase").when(new < old, "price_decrease").otherwise("price_changed")


def stock_event_type(new: Column) -> Column:
    return F.when(new == "in_stock", "stock_in").otherwise("stock_out")


def percent(diff: Column, old: Column) -> Column:
    """Change in percent of the old price, exact decimals; null when the old price is zero or absent."""
    return F.when(old != 0, F.round(diff * 100 / old, 2)).cast("decimal(18,2)")


def plain_number(price: Column) -> Column:
    """A price as a plain number: 10.0, 12.5, 12.55, or None."""
    return F.coalesce(F.regexp_replace(price.cast("string"), "0$", ""), F.lit("None"))


def scan_events(sequence: DataFrame, now, columns=EVENT_COLUMNS) -> DataFrame:
    """Typed events of a change sequence: up to two per item, one per removal.

    A row is multiplied by the kinds of its events only, and the payloads are told of each kind afterwards, so that a reader of few `columns` reads
    only what those are made of.
    """
    c = F.col
    diff = (c("price") - c("old_price")).cast("decimal(12,2)")
    kinds = {
        "new": {
            "event_type": F.lit("new_product"), "event_message": F.concat(F.lit("New product found: "), c("title")),
            "new_value": {"title": c("title"), "category": c("category"), "price": F.when(c("price") != 0, c("price")),
                          "currency": c("currency"), "stock_status": c("stock_status"), "url": c("url")},
        },
        "price": {
            "event_type": price_event_type(c("old_price"), c("price")),
            "event_message": F.concat(F.lit("Price changed for "), c("old_title"), F.lit(": "), plain_number(c("old_price")), F.lit(" -> "),
                                      plain_number(c("price"))),
            "old_value": {"price": c("old_price"), "currency": c("old_currency"), "category": c("old_category")},
            "new_value": {"price": c("price"), "currency": c("item_currency"), "category": c("category"),
                          "diff_amount": diff, "diff_percentage": percent(diff, c("old_price"))},
        },
        "stock": {
            "event_type": stock_event_type(c("stock_status")),
            "event_message": F.concat(F.lit("Stock changed for "), c("old_title"), F.lit(": "), c("old_stock"), F.lit(" -> "), c("stock_status")),
            "old_value": {"stock_status": c("old_stock"), "category": c("old_category")},
            "new_value": {"stock_status": c("stock_status"), "category": c("category")},
        },
        "removed": {
            "event_type": F.lit("product_removed"), "event_message": F.concat(F.lit("Product no longer seen: "), c("title")),
            "old_value": {"url": c("url"), "title": c("title"), "category": c("category")},
        },
    }

    def of_kind(name: str, told=lambda value: value) -> Column:
        return F.coalesce(*[F.when(c("kind") == kind, told(parts[name])) for kind, parts in kinds.items() if name in parts])

    made = {
        "event_type": of_kind("event_type"), "old_value": of_kind("old_value", _payload), "new_value": of_kind("new_value", _payload),
        "event_message": of_kind("event_message"), "detected_at": F.lit(str(now)).cast("timestamp"),
    }
    hit = sequence.where("is_new or price_changed or stock_changed or is_removed")
    found = F.array_compact(F.array(
        F.when(c("is_new"), "new"), F.when(c("price_changed"), "price"), F.when(c("stock_changed"), "stock"), F.when(c("is_removed"), "removed"),
    ))
    return hit.select("*", F.explode(found).alias("kind")).select(*[made.get(name, c(name)).alias(name) for name in columns])


_PAYLOAD = {
    "title": "string", "url": "string", "price": "decimal(12,2)", "currency": "string", "stock_status": "string",
    "category": "string", "diff_amount": "decimal(12,2)", "diff_percentage": "decimal(18,2)",
}


def _payload(values: dict[str, Column]) -> Column:
    """Payload struct with every key."""
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in _PAYLOAD.items()])


def scan_snapshots(sequence: DataFrame, now) -> DataFrame:
    """Snapshots are written on change only; a changed external id alone is no change."""
    return sequence.where("snapshot_needed").select(
        "product_id", "competitor_id", "item_ix", "title", "category", "price", "currency", "stock_status", "image_url",
        F.lit(str(now)).cast("timestamp").alias("checked_at"),
    )


def next_state(sequence: DataFrame, now, columns=STATE_COLUMNS) -> DataFrame:
    """State after the scan: seen products as last scanned, unseen ones with one more miss, removed ones inactive."""
    c = F.col
    kinds = {f.name: f.dataType for f in sequence.schema.fields}
    made = {
        "consecutive_misses": F.when(c("is_missed"), F.coalesce("consecutive_misses", F.lit(0)) + 1).otherwise(c("consecutive_misses")),
        "active": c("active") & ~c("is_removed"),
        "last_checked_at": F.when(c("is_missed"), F.lit(str(now)).cast(kinds.get("last_checked_at", "timestamp"))).otherwise(c("last_checked_at")),
    }
    return sequence.where("is_last").select(*[made.get(name, c(name)).cast(kinds[name]).alias(name) for name in columns])


@dataclass
class ScanResult:
    sequence: DataFrame
    state: DataFrame
    snapshots: DataFrame
    events: DataFrame
    scans: DataFrame


def apply_scan(
    state: DataFrame, items: DataFrame, scans: DataFrame, now, keep_sequence: bool = False, errors: DataFrame | None = None,
    reads: dict[str, tuple] | None = None,
) -> ScanResult:
    """Apply one batch. With `keep_sequence` the shared sequence is checkpointed once for all outputs.

    The items of a scan in `errors` (competitor_id, error) are not applied and its products count no miss.

    `reads` names the columns of "events" and of "state" that will be read, where that is not all: these outputs have those columns, and the kept
    sequence only what they are made of, which is a small part of a row. The snapshots are then made of the sequence as it was before.

    Items are expected to be deduplicated per competitor (`dedupe_catalog`), as every landing source does; repeated
    urls and external ids are still handled in order, but then one product's items form one sequence in one task.

    Rows of shops without a scan record are neither matched nor ordered; they go over to the new state as they are.

    The items are checkpointed: the guard, the search for products and the sequence all start from them, so they are parsed once, and a step reads
    only the columns that it needs.
    """
    shops = scans.select("competitor_id").distinct()
    scanned = state.join(shops, "competitor_id", "left_semi")
    items = cut_lineage(items)
    judged = cut_lineage(split_scans(scans, items, errors))
    accepted = judged.where("accepted").select("competitor_id")
    # Items without url, or of a competitor without a scan record, do not belong to the batch.
    batch = items.where("url <> ''").join(accepted, "competitor_id", "left_semi")
    whole = sequence = change_sequence(scanned, batch, accepted, now)
    columns = {"events": EVENT_COLUMNS, "state": STATE_COLUMNS} | (reads or {})
    if keep_sequence:
        sequence = cut_lineage(sequence.select(*_kept(sequence, columns)))
    untouched = state.join(shops, "competitor_id", "left_anti").select(*columns["state"])
    after = next_state(sequence, now, columns["state"]).unionByName(untouched)
    snapshots = scan_snapshots(whole if reads else sequence, now)
    return ScanResult(sequence, after, snapshots, scan_events(sequence, now, columns["events"]), judged)


def _kept(sequence: DataFrame, columns: dict[str, tuple]) -> list[str]:
    """The columns of the sequence that those columns of its outputs are made of."""
    names = set()
    for output, wanted in columns.items():
        if not set(wanted) <= set(MADE_OF[output]):
            return sequence.columns
        for name in ("", *wanted):
            names |= {name, *MADE_OF[output][name]}
    return [c for c in sequence.columns if c in names]


def scan_summary(sequence: DataFrame) -> DataFrame:
    """New products and price changes per competitor."""
    return sequence.groupBy("competitor_id").agg(
        F.count_if("is_new").alias("new_products"), F.count_if("price_changed").alias("price_changes")
    )


def scan_runs(judged: DataFrame, summary: DataFrame, errors: DataFrame | None, now) -> DataFrame:
    """Run log of a batch, with a row for every scan and for every shop in `errors` (competitor_id, error)."""
    empty = "Scrape returned 0 products. Treating this as a failed scan to avoid marking the catalog missing."
    rows = judged.join(summary, "competitor_id", "left")
    message = F.when(~F.col("accepted"), F.lit(empty))
    if errors is not None:
        first = errors.groupBy("competitor_id").agg(F.min("error").alias("error"))
        rows = rows.join(first, "competitor_id", "full_outer")
        message = F.coalesce("error", message)
    failed = message.isNotNull()
    zero = F.lit(0).cast("long")

    def unless_failed(column):
        return F.when(failed, zero).otherwise(F.coalesce(column, zero))

    return rows.select(
        "competitor_id",
        F.when(failed, "failed").otherwise("success").alias("status"),
        unless_failed("products_found").alias("products_found"),
        unless_failed("new_products").alias("new_products_count"),
        unless_failed("price_changes").alias("price_changes_count"),
        message.alias("error_message"),
        F.lit(str(now)).cast("timestamp").alias("finished_at"),
    )


def failure_events(runs: DataFrame) -> DataFrame:
    """One scrape_failed event per failed run, with the run's message."""
    return runs.where("status = 'failed'").select(
        "competitor_id", F.lit("scrape_failed").alias("event_type"),
        F.col("error_message").alias("event_message"), F.col("finished_at").alias("detected_at"),
    )
