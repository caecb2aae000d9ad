"""Market identity of a product title: its base name and its variant ("mutation")."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.constants import DESCRIPTOR_TOKENS, MUTATION_MARKERS, MUTATION_PHRASES, STAT_TOKENS
from shelfwatch.functions.text import blank_to_null, words

SINGLE_WORDS = [p for p in MUTATION_PHRASES if " " not in p]
WORD_PAIRS = [p for p in MUTATION_PHRASES if " " in p]
ANY_PHRASE_WORD = " (?:" + "|".join(p.split()[0] for p in MUTATION_PHRASES) + ") "
DROPPED_WORD = r"(?:^| )(?:[^ ]*\p{Nd}[^ ]*|" + "|".join(STAT_TOKENS) + r")(?= |$)"
# A word with a digit and one of the quantity units.
QUANTITY_WORD = r"(?:^| )(?=[^ ]*\p{Nd})(?=[^ ]*(?:m|b|qn))"


def clean_tokens(title: Column) -> Column:
    """A normalised title without its numbers and stat words."""
    return F.trim(F.regexp_replace(title, DROPPED_WORD, ""))


def with_extraction(df: DataFrame, title: Column) -> DataFrame:
    """`df` with `cleaned`, `variant_part` and `base_part`: variant phrases and the remaining words of a title.

    Phrases are looked up in table order, so that is also their order in the result. Only the first occurrence of each
    is taken out; no word belongs to two phrases.
    """
    df = df.withColumn("cleaned", clean_tokens(title))
    df = df.withColumn("_padded", F.concat(F.lit(" "), "cleaned", F.lit(" ")))
    padded = F.col("_padded")
    phrases = F.array(*[F.lit(f" {p} ") for p in MUTATION_PHRASES])
    none = F.array().cast("array<string>")
    # Most titles name no phrase; a single expression tells them apart.
    found = F.when(padded.rlike(ANY_PHRASE_WORD), F.filter(phrases, lambda p: F.contains(padded, p))).otherwise(none)
    df = df.withColumn("_found", found)

    def pair_start(pair):
        """Index of the first word of the pair's first occurrence: the number of blanks before it."""
        before = F.substring_index(padded, f" {pair} ", 1)
        return F.when(padded.contains(f" {pair} "), F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))))

    starts = {f"_pair{i}": F.coalesce(pair_start(p), F.lit(-9)) for i, p in enumerate(WORD_PAIRS)}
    df = df.withColumns({**starts, "_words": F.split("cleaned", " ")})

    def stays(word, i):
        in_pair = reduce(or_, [(i == F.col(n)) | (i == F.col(n) + 1) for n in starts])
        return ~(in_pair | (word.isin(*SINGLE_WORDS) & (F.array_position("_words", word) == i + 1)))

    hit = F.size("_found") > 0
    return df.withColumns({
        "variant_part": F.when(hit, F.array_join(F.transform("_found", lambda p: F.trim(p)), " ")).otherwise(""),
        "base_part": F.when(hit, F.array_join(F.filter("_words", stays), " ")).otherwise(F.col("cleaned")),
    }).drop("_padded", "_found", "_words", *starts)


def with_identity(df: DataFrame, title: str = "normalized_title", category: str = "category", base_hint: Column | None = None) -> DataFrame:
    """`df` with identity_key, base, mutation, mutation_label and display_title.

    Variants are split off when category or title mark a game with variants, when a title word is a quantity, or when
    the words left over are exactly `base_hint`.
    """
    df = with_extraction(df, F.col(title)).withColumn("own_split", splits_by_itself(F.col(title), F.col(category)))
    split = F.col("own_split")
    if base_hint is not None:
        split = split | F.coalesce((base_hint != "") & (F.col("variant_part") != "") & (F.col("base_part") == base_hint), F.lit(False))
    df = df.withColumn("_split", split)
    df = df.withColumns({
        "base": F.coalesce(
            F.when(F.col("_split"), blank_to_null(F.col("base_part"))), blank_to_null(F.col("cleaned")), F.col(title)
        ),
        "mutation": F.when(F.col("_split") & (F.col("variant_part") != ""), F.col("variant_part")).otherwise("normal"),
    })
    label = F.when(F.col("mutation") == "normal", "Normal").otherwise(F.initcap("mutation"))
    shown = F.when(F.col("mutation") == "normal", F.initcap("base")).otherwise(F.concat(F.initcap("mutation"), F.lit(" "), F.initcap("base")))
    return df.withColumns({
        "identity_key": F.concat("base", F.lit("::"), "mutation"), "mutation_label": label, "display_title": shown,
    }).drop("_split", "own_split", "cleaned", "variant_part", "base_part")


def splits_by_itself(title: Column, category: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(category, F.lit("")), F.lit(" "), title))
    return reduce(or_, [text.contains(m) for m in MUTATION_MARKERS]) | title.rlike(QUANTITY_WORD)


def comparison_aliases(title: Column) -> Column:
    """The title, and the title without descriptor words where any are left."""
    compact = F.array_join(F.filter(words(title), lambda t: ~t.isin(*DESCRIPTOR_TOKENS)), " ")
    return F.array_distinct(F.array_compact(F.array(title, blank_to_null(compact))))
