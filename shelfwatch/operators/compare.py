"""The same product across shops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.constants import COMPARE_THRESHOLD
from shelfwatch.functions.similarity import sequence_ratio
from shelfwatch.functions.text import fold_title, words
from shelfwatch.operators.fuzzy_join import contained_texts, least_matched, shared_letters, similar_texts
from shelfwatch.operators.identity import comparison_aliases, splits_by_itself, with_extraction, with_identity
from shelfwatch.operators.search import search_candidates
from shelfwatch.session import cut_lineage, with_distinct, with_values


def exact_comparison(query: Column, candidate: Column) -> Column:
    """Comparison score where no ratio is needed, null elsewhere."""
    q, c = words(query), words(candidate)
    return (
        F.when(query.isNull() | candidate.isNull() | (query == "") | (candidate == ""), 0.0)
        .when(query == candidate, 1.0)
        .when((F.size(q) == 1) & F.array_contains(c, query), F.when(F.size(c) == 1, 0.94).otherwise(0.72))
        .when(F.size(F.array_except(q, c)) == 0, 0.9)
    )


def with_comparison_score(df: DataFrame, pairs: list[tuple[Column, Column]], name: str = "score", least: float = 0.0) -> DataFrame:
    """`df` with the best comparison score of the given text pairs; a null text takes no part.

    Scores below `least` need not be right: a ratio is at most twice the letters that both texts have over both lengths, so pairs whose
    lengths or letters rule `least` out are not sent to Python.

    Ratios are asked for only where the rules leave a pair open and no other pair is already equal.
    """
    exact = {f"_e{i}": F.when(a.isNotNull() & b.isNotNull(), exact_comparison(a, b)) for i, (a, b) in enumerate(pairs)}
    df = df.withColumns(exact)
    equal = F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in exact]) == 1.0
    df = df.withColumn("_equal", equal)
    ratios = {}
    for i, (a, b) in enumerate(pairs):
        open_pair = ~F.col("_equal") & F.col(f"_e{i}").isNull() & a.isNotNull() & b.isNotNull()
        if least > 0:
            enough = least_matched(F.length(a) + F.length(b), least)
            open_pair &= (F.least(F.length(a), F.length(b)) >= enough) & (shared_letters(a, b) >= enough)
        ratios[f"_r{i}"] = sequence_ratio(F.when(open_pair, a), F.when(open_pair, b))
    df = df.withColumns(ratios)
    best = F.greatest(F.lit(0.0), *[F.coalesce(f"_e{i}", f"_r{i}", F.lit(0.0)) for i in range(len(pairs))])
    return df.withColumn(name, best).drop("_equal", *exact, *ratios)


def compare_target(
    products: DataFrame, product_id=None, q: str | None = None, candidate_limit: int | None = None, blocked: bool = False
) -> DataFrame:
    """The product to compare: by id, and where the id finds none the best match of the query among active products. At most one row."""
    named = products.where(F.col("id") == product_id).limit(1) if product_id is not None else None
    if q is None:
        return products.limit(0) if named is None else named
    rows = with_distinct(search_candidates(products, q, candidate_limit, blocked), ["normalized_title"],
                         lambda t: with_comparison_score(t, [(F.lit(fold_title(q)), F.col("normalized_title"))]))
    order = [F.desc("score"), F.col("last_checked_at").desc_nulls_first(), F.asc("id")]
    found = rows.orderBy(*order).limit(1).select(products.columns)
    if named is None:
        return found
    # two rows at most
    return named.withColumn("_rank", F.lit(0)).unionByName(found.withColumn("_rank", F.lit(1))).orderBy("_rank").limit(1).drop("_rank")


def title_readings(titles: DataFrame) -> DataFrame:
    """Titles (normalized_title, category) with each way they may be read: (base, mutation), and `hint`, the base a target must have for a reading by it.

    A title whose words apart from its variant phrases are exactly the target's base counts under that variant (the reading with that
    `hint`), and then not as it stands; `base_part` and `hinted` tell which targets its own reading is not for.
    """
    rows = with_extraction(titles, F.col("normalized_title"))
    rows = rows.withColumn("own_split", splits_by_itself(F.col("normalized_title"), F.col("category")))
    hinted = ~F.col("own_split") & (F.col("variant_part") != "") & (F.col("base_part") != "")
    own_mutation = F.when(F.col("own_split") & (F.col("variant_part") != ""), F.col("variant_part")).otherwise("normal")
    own_base = F.coalesce(
        F.when(F.col("own_split"), F.nullif("base_part", F.lit(""))), F.nullif("cleaned", F.lit("")), F.col("normalized_title")
    )
    none = F.lit(None).cast("string")
    readings = F.array_compact(F.array(
        F.struct(own_mutation.alias("mutation"), own_base.alias("base"), none.alias("hint")),
        F.when(hinted, F.struct(F.col("variant_part").alias("mutation"), F.col("base_part").alias("base"), F.col("base_part").alias("hint"))),
    ))
    rows = rows.withColumn("barred", F.when(hinted, F.col("base_part")))
    return rows.select("normalized_title", "category", "barred", F.explode(readings).alias("r")).select("*", "r.*").drop("r")


def compare_product(products: DataFrame, competitors: DataFrame, target: DataFrame) -> DataFrame:
    """Best matching active product of every active competitor for one target, nulls where there is none.

    The target is one row, so it is broadcast. It meets the readings of the catalog's distinct titles in an equi-join on the variant; products
    are joined to the titles that match.
    """
    wanted = with_identity(target).select(
        F.col("base").alias("target_base"), "mutation", comparison_aliases(F.col("base")).alias("target_aliases"),
    )

    def matching(titles):
        met = title_readings(titles).join(F.broadcast(wanted), "mutation").where(_applies(F.col("target_base")))
        aliases = comparison_aliases(F.col("base"))
        met = met.withColumns({
            "t0": F.get("target_aliases", F.lit(0)), "t1": F.get("target_aliases", F.lit(1)),
            "c0": F.get(aliases, F.lit(0)), "c1": F.get(aliases, F.lit(1)),
        })
        scored = with_comparison_score(met, [(F.col(t), F.col(c)) for t in ("t0", "t1") for c in ("c0", "c1")], least=COMPARE_THRESHOLD)
        return scored.where(F.col("score") >= COMPARE_THRESHOLD).select("normalized_title", "category", "score")

    best = with_distinct(products.where("active"), ["normalized_title", "category"], matching).groupBy("competitor_id").agg(
        F.min_by(F.struct(F.round("score", 3).alias("match_score"), F.col("id").alias("product_id"), "normalized_title",
                          "current_price", "currency"), _best_first()).alias("b")
    )
    active = competitors.where("active").select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return (
        active.join(best, "competitor_id", "left")
        .select("competitor_id", "competitor_name", F.coalesce("b.match_score", F.lit(0.0)).alias("match_score"), "b.product_id",
                "b.normalized_title", "b.current_price", "b.currency")
        .orderBy(F.col("product_id").isNull(), F.col("current_price").asc_nulls_last(), "competitor_id")
    )


def _applies(target_base: Column) -> Column:
    """Whether a reading is the one to compare with a target: by its hint where the target has that base, else its own."""
    return F.when(F.col("hint").isNotNull(), F.col("hint") == target_base).otherwise(F.col("barred").isNull() | (F.col("barred") != target_base))


def _best_first() -> Column:
    return F.struct(-F.col("score"), F.col("current_price").isNull(), F.col("current_price"), F.col("id"))


def comparison_head(target: DataFrame, matches: DataFrame) -> DataFrame:
    """What a comparison says of its target, beside the rows of `compare_product`: identity, aliases, and how many shops have a match."""
    named = with_identity(target).select(
        F.col("id").alias("target_id"), "identity_key", "base", "mutation", "mutation_label", "display_title",
        F.array_sort(comparison_aliases(F.col("base"))).alias("aliases"), F.lit(1).alias("one"),
    )
    total = matches.agg(F.count("product_id").alias("total_matches")).withColumn("one", F.lit(1))
    return named.join(total, "one").drop("one")


def base_scores(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target_base, base, score): the pairs of bases of `targets` and `candidates` (base) that compare with the threshold or more.

    The score of two bases is the best of their aliases': equal ones 1.0, one with all words of the other 0.9, else the ratio.
    """
    def aliased(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("base").alias(name)).where("base is not null").distinct().select(name, F.explode(comparison_aliases(F.col(name))).alias("text"))

    one, other = aliased(targets, "target_base"), aliased(candidates, "base")
    exact = contained_texts(one, other).withColumn("score", F.lit(0.9))
    # a single word that is one of several scores 0.72, whatever its ratio
    word = (F.size(words(F.col("a"))) == 1) & F.array_contains(words(F.col("b")), F.col("a"))
    ratios = similar_texts(one, other, COMPARE_THRESHOLD).where(~word).select("a", "b", F.col("ratio").alias("score"))
    ratios = ratios.join(exact.select("a", "b"), ["a", "b"], "left_anti")
    scored = exact.unionByName(ratios)
    pairs = scored.join(one.withColumnRenamed("text", "a"), "a").join(other.withColumnRenamed("text", "b"), "b").select("target_base", "base", "score")
    equal = one.join(other, "text").select("target_base", "base", F.lit(1.0).alias("score"))
    return pairs.unionByName(equal).groupBy("target_base", "base").agg(F.max("score").alias("score"))


def market_comparison_fuzzy(products: DataFrame) -> DataFrame:
    """For every identity and every competitor with a match, the best matching active product: `compare_product` for all targets at once.

    Titles are read once each. Offers are reduced to the best per reading and competitor first, because all products of a reading have the same
    score. Texts are compared once per pair of different bases, in a similarity join that compares no pair that cannot reach the threshold.
    """
    key = ["normalized_title", "category"]
    titles = cut_lineage(products.groupBy(*key).agg(F.max(F.coalesce("active", F.lit(False))).alias("active")))
    targets = cut_lineage(with_identity(titles).select(F.col("base").alias("target_base"), "mutation").distinct())
    readings = cut_lineage(title_readings(titles.where("active").select(*key)))
    cheapest = F.struct(F.col("current_price").isNull(), F.col("current_price"), F.col("id"))
    offers = with_values(products.where("active"), key, readings).groupBy("mutation", "base", "hint", "barred", "competitor_id").agg(
        F.min_by(F.struct("id", "normalized_title", "current_price"), cheapest).alias("o")).select("mutation", "base", "hint", "barred", "competitor_id", "o.*")
    scores = base_scores(targets.select(F.col("target_base").alias("base")), readings.select("base"))
    met = targets.join(scores, "target_base").join(offers, ["mutation", "base"]).where(_applies(F.col("target_base")))
    best = met.groupBy("target_base", "mutation", "competitor_id").agg(
        F.min_by(F.struct(F.round("score", 3).alias("match_score"), F.col("id").alias("product_id"), "normalized_title", "current_price"), _best_first()).alias("b"))
    return best.select(F.col("target_base").alias("base"), "mutation", "competitor_id", "b.*")


def market_comparison(products: DataFrame) -> DataFrame:
    """All identities at once: the best offer per competitor next to the market's cheapest offer and spread.

    Identities are told once per title. Two aggregations on the identity, the first per competitor; both combine on the map side. The join back has one row
    per identity on one side and one per seller on the other, whatever the number of products. Both sides use the same
    columns of the offers, so their shuffle is done once and reused.
    """
    rows = with_distinct(products, ["normalized_title", "category"], lambda t: with_identity(t).select("normalized_title", "category", "base", "mutation"))
    key = ["base", "mutation"]
    offers = rows.groupBy(*key, "competitor_id").agg(
        F.min_by(F.struct(F.col("current_price").alias("price"), F.col("id").alias("product_id")),
                 F.struct(F.col("current_price").isNull(), F.col("current_price"), F.col("id"))).alias("o"),
        F.count("*").alias("n_offers"),
    ).select(*key, "competitor_id", "o.*", "n_offers")
    market = offers.groupBy(*key).agg(
        F.count("*").alias("n_competitors"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.min_by(F.struct(F.col("competitor_id").alias("cheapest_competitor_id"), F.col("product_id").alias("cheapest_product_id")),
                 F.struct(F.col("price").isNull(), F.col("price"), F.col("competitor_id"))).alias("c"),
        F.sum("n_offers").alias("n_products"),
    ).select(*key, "n_competitors", "low", "high", "c.*", "n_products")
    return offers.join(market, key).withColumn("spread", F.col("high") - F.col("low"))
