"""Fuzzy product search and suggestions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.constants import SEARCH_THRESHOLD
from shelfwatch.functions.similarity import fuzzy_part
from shelfwatch.functions.text import fold_title, words
from shelfwatch.operators.identity import with_extraction, with_identity
from shelfwatch.operators.listing import first_page
from shelfwatch.session import cut_lineage, with_distinct
from shelfwatch.sources.tables import with_competitor


def token_variants(title: Column) -> Column:
    """Each word of a normalised text, its 4-prefix if longer than 4 and its 6-prefix if longer than 6."""
    expand = F.transform(words(title), lambda t: F.array_compact(F.array(
        t, F.when(F.length(t) > 4, F.substring(t, 1, 4)), F.when(F.length(t) > 6, F.substring(t, 1, 6))
    )))
    return F.array_distinct(F.flatten(expand))


def _variants(norm: str) -> list[str]:
    found = {v for t in norm.split() for v in (t, t[:4], t[:6])}
    return sorted(v for v in found if len(v) >= 2)


def search_candidates(products: DataFrame, q: str, candidate_limit: int | None = None, blocked: bool = False) -> DataFrame:
    """The active products, or with `blocked` those whose title contains any variant of a query word (all of them if no variant is long enough).

    The variants save scoring, but a word misspelt in its first letters is not found by them. The newest `candidate_limit` may be asked
    for; by default nothing is cut off.
    """
    rows = products.where("active")
    variants = _variants(fold_title(q))
    if blocked and variants:
        rows = rows.where(reduce(or_, [F.contains("normalized_title", F.lit(v)) for v in variants]))
    if candidate_limit is not None:
        # written once, so that all readers see the same rows where the order leaves ties open
        rows = cut_lineage(rows.orderBy(F.col("last_checked_at").desc_nulls_first(), F.col("id").asc()).limit(candidate_limit))
    return rows


def with_match_scores(df: DataFrame, query: Column, candidates: dict[str, Column]) -> DataFrame:
    """`df` with the match score of the query text and each named candidate text, all normalised.

    A substring hit scores 1.0 and full word overlap 0.9, which no weighted ratio exceeds, so those rows are decided
    without Python. The others reach it with only the two texts, for all candidates in one Python stage.
    """
    df = df.withColumn("_q", query).withColumn("_q_words", F.array_distinct(words(F.col("_q"))))
    df = df.withColumns({f"_c_{n}": c for n, c in candidates.items()})
    overlap, exact, fuzzy, score = {}, {}, {}, {}
    for n in candidates:
        q, c = F.col("_q"), F.col(f"_c_{n}")
        shared = F.size(F.array_intersect("_q_words", words(c)))
        overlap[f"_o_{n}"] = shared / F.greatest(F.size("_q_words"), F.lit(1))
        empty = (F.coalesce(q, F.lit("")) == "") | (F.coalesce(c, F.lit("")) == "")
        exact[f"_e_{n}"] = F.when(empty, 0.0).when(F.contains(c, q), 1.0).when(F.col(f"_o_{n}") == 1, 0.9)
        unknown = F.col(f"_e_{n}").isNull()
        fuzzy[f"_f_{n}"] = fuzzy_part(F.when(unknown, q), F.when(unknown, c))
        score[n] = F.coalesce(f"_e_{n}", F.greatest(F.col(f"_o_{n}") * 0.9, F.col(f"_f_{n}")))
    df = df.withColumns(overlap).withColumns(exact).withColumns(fuzzy).withColumns(score)
    return df.drop("_q", "_q_words", *[f"_c_{n}" for n in candidates], *overlap, *exact, *fuzzy)


def with_match_score(df: DataFrame, query: Column, candidate: Column, name: str = "score") -> DataFrame:
    return with_match_scores(df, query, {name: candidate})


def exact_match_scores(df: DataFrame, query: Column, candidate: Column) -> DataFrame:
    """Only the rows whose score needs no ratio: substring hits and full word overlap."""
    covered = F.size(F.array_except(words(query), words(candidate))) == 0
    score = F.when(F.contains(candidate, query), 1.0).when(covered, 0.9)
    return df.withColumn("score", score).where("score is not null")


def search_results(products: DataFrame, competitors: DataFrame, q: str, candidate_limit: int | None = None, blocked: bool = False) -> DataFrame:
    """All products scoring at least the threshold, which is applied before rounding. Titles are scored once each."""
    def scored(titles):
        rows = with_match_score(titles, F.lit(fold_title(q)), F.col("normalized_title"))
        return rows.where(F.col("score") >= SEARCH_THRESHOLD).withColumn("match_score", F.round("score", 3)).drop("score")

    return with_competitor(with_distinct(search_candidates(products, q, candidate_limit, blocked), ["normalized_title"], scored), competitors)


def search_products(
    products: DataFrame, competitors: DataFrame, q: str, page: int = 1, page_size: int = 50, candidate_limit: int | None = None,
    blocked: bool = False,
) -> DataFrame:
    """A page of results: best score first, then cheapest, prices missing last."""
    order = [F.desc("match_score"), F.col("current_price").asc_nulls_last(), F.asc("id")]
    return first_page(search_results(products, competitors, q, candidate_limit, blocked), order, page, page_size)


def title_index(titles: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(gram, title) of distinct titles (title): every substring of the given lengths, an inverted index to join queries to."""
    def grams(n):
        every = F.transform(F.sequence(F.lit(1), F.length("title") - n + 1), lambda i: F.substring("title", i, n))
        return F.when(F.length("title") >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return titles.select("title", F.explode(F.flatten(F.array(*map(grams, sizes)))).alias("gram"))


def candidates_of_many(queries: DataFrame, titles: DataFrame, cell: int = 20_000) -> DataFrame:
    """(query, title), distinct: the titles (title) that contain a variant of a word of a query (query), all normalised.

    A variant is looked up in the index by the rarest of its grams and then checked as a whole. Variants and titles are distinct texts, so what many
    queries ask is looked up once; a gram of very many titles is dealt to cells of about `cell`. A query without a variant of two letters
    finds nothing here; `search_candidates` takes it.
    """
    index = title_index(titles.where("title is not null").select("title").distinct())
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = queries.where("query is not null").select("query").distinct()
    asked = asked.select("query", F.explode(token_variants(F.col("query"))).alias("variant")).where(F.length("variant") >= 2)
    width = F.least(F.length("variant"), F.lit(4))
    grams = F.transform(F.sequence(F.lit(1), F.length("variant") - width + 1), lambda i: F.substring(F.col("variant"), i, width))
    # a gram that no title has rules the variant out
    rarest = asked.select("variant").distinct().select("variant", F.explode(grams).alias("gram")).join(frequency, "gram", "left").groupBy("variant").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("variant", "r.*").where("n > 0")
    cells = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    looked_up = rarest.select("variant", "gram", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    dealt = index.join(frequency, "gram").select("gram", "title", F.pmod(F.xxhash64("title"), cells).cast("int").alias("cell"))
    found = looked_up.join(dealt, ["gram", "cell"]).where(F.contains("title", F.col("variant"))).select("variant", "title")
    return asked.join(found, "variant").select("query", "title").distinct()


def search_many(queries: DataFrame, titles: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, title, match_score) of every hit of many queries at once; with `limit` the best ones of each query, ties by title.

    Both sides are distinct normalised texts; products are joined to their titles afterwards. The threshold counts before rounding.
    """
    scored = with_match_score(candidates_of_many(queries, titles), F.col("query"), F.col("title"))
    hits = scored.where(F.col("score") >= SEARCH_THRESHOLD)
    if limit is not None:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "title")
        hits = hits.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= limit).drop("pos")
    return hits.withColumn("match_score", F.round("score", 3)).drop("score")


def with_base_hint(df: DataFrame, q: str) -> DataFrame:
    """`df` with `base_hint`: the query's words that are left after its variant phrases, or all of them.

    The expression is over a literal; it is the plan's business to compute it once.
    """
    rows = with_extraction(df, F.lit(fold_title(q)))
    hint = F.coalesce(F.nullif("base_part", F.lit("")), "cleaned")
    return rows.withColumn("base_hint", hint).drop("cleaned", "variant_part", "base_part")


def suggestion_rows(products: DataFrame, competitors: DataFrame, q: str, candidate_limit: int | None = None, blocked: bool = False) -> DataFrame:
    """Candidates with market identity and score, the better of title and base; both are told once per title and category."""
    def scored(titles):
        rows = with_identity(with_base_hint(titles, q), base_hint=F.col("base_hint")).drop("base_hint")
        rows = with_match_scores(rows, F.lit(fold_title(q)), {"title_score": F.col("normalized_title"), "base_score": F.col("base")})
        return rows.withColumn("match_score", F.greatest("title_score", "base_score")).where(F.col("match_score") >= SEARCH_THRESHOLD)

    rows = with_distinct(search_candidates(products, q, candidate_limit, blocked), ["normalized_title", "category"], scored)
    return with_competitor(rows, competitors)


def identity_groups(rows: DataFrame) -> DataFrame:
    """One row per market identity: head from the newest row, offer from the cheapest, variants and sellers counted.

    Every aggregate combines on the map side, including the distinct counts, so a popular identity is no hot spot.
    """
    newest = F.struct(F.col("last_checked_at").isNotNull().cast("int"), -F.unix_micros(F.col("last_checked_at").cast("timestamp")), F.col("id"))
    cheapest = F.struct(F.col("current_price").isNull(), F.col("current_price"), newest)
    groups = rows.groupBy("identity_key").agg(
        F.min_by(F.struct("display_title", "base", "mutation", "mutation_label", "category"), newest).alias("head"),
        F.min_by(F.struct(F.col("id").alias("representative_product_id"), F.col("current_price").alias("best_price"), "currency", "image_url"),
                 cheapest).alias("offer"),
        F.max("match_score").alias("match_score"),
        F.count_distinct("competitor_name").alias("competitors_count"),
        F.count("*").alias("n_products"),
    )
    return groups.select("identity_key", "head.*", "offer.*", "match_score", "competitors_count", "n_products")


def group_variants(rows: DataFrame, n: int = 5, title: str = "title") -> DataFrame:
    """The first `n` distinct titles of each identity, in order.

    A row_number filtered to a constant is planned with a limit before the shuffle: a task sends at most `n` rows per key.
    """
    order = Window.partitionBy("identity_key").orderBy(title)
    distinct = rows.select("identity_key", title).distinct()
    return distinct.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def group_competitors(rows: DataFrame) -> DataFrame:
    """Distinct (identity, competitor) pairs as rows: the number of sellers of an identity is not bounded."""
    return rows.select("identity_key", "competitor_name").distinct()


def search_suggestions(
    products: DataFrame, competitors: DataFrame, q: str, limit: int = 20, candidate_limit: int | None = None, blocked: bool = False
) -> DataFrame:
    """The best groups with their first five title variants.

    The scored hits are checkpointed, because groups and variants both need them and scoring is the expensive part.
    """
    rows = cut_lineage(suggestion_rows(products, competitors, q, candidate_limit, blocked).select(
        "identity_key", "display_title", "base", "mutation", "mutation_label", "category", "id", "title", "current_price", "currency",
        "image_url", "last_checked_at", "match_score", "competitor_name",
    ))
    groups = identity_groups(rows).withColumn("match_score", F.round("match_score", 3))
    order = [F.desc("match_score"), F.desc("competitors_count"), F.col("best_price").asc_nulls_last(), F.asc("identity_key")]
    top = first_page(groups, order, 1, limit)
    variants = group_variants(rows).groupBy("identity_key").agg(F.array_sort(F.collect_list("title")).alias("variants"))
    return top.join(variants, "identity_key")
