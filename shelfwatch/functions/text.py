"""Text expressions. Everything stays in the JVM except NFKD folding and rare HTML entities."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions.binding import let

NOT_ASCII = r"[^\x00-\x7F]"
# Any ampersand that is not one of the plain entities below.
OTHER_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|#39);)"
PLAIN_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def blank_to_null(c: Column) -> Column:
    """Empty text counts as absent throughout the catalog rules."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def fold_title(title: str | None) -> str | None:
    """The title rule for a single value, such as a search text."""
    if title is None:
        return None
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", title).lower()).split())


@F.pandas_udf(T.StringType())
def _fold(titles: pd.Series) -> pd.Series:
    return titles.map(fold_title)


def normalize_title(title: Column) -> Column:
    """Lower-case words separated by single blanks; null becomes empty.

    ASCII titles are done in the JVM. Spark has no NFKD, so only the other titles are sent to Python; the ASCII rows
    reach the Python worker as nulls.
    """
    plain = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9_]+", " "))
    folded = _fold(F.when(title.rlike(NOT_ASCII), title))
    return F.coalesce(F.when(~title.rlike(NOT_ASCII), plain), folded, F.lit(""))


def normalize_ascii_title(title: Column) -> Column:
    """`normalize_title` for columns known to be ASCII: no Python stage in the plan."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9_]+", " ")), F.lit(""))


def plain_unescape(c: Column) -> Column:
    for entity, text in PLAIN_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def _unescape_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


# Declared non-deterministic so that a filter on the result stays above it and texts go to Python once.
_unescape = F.pandas_udf(_unescape_texts, T.StringType()).asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda bs: None if bs is None else [html.unescape(b) for b in bs])


def unescape(c: Column) -> Column:
    """Resolve HTML entities; Python sees only the texts with an unusual one."""
    return F.coalesce(_unescape(F.when(c.rlike(OTHER_ENTITY), c)), plain_unescape(c))


def unescape_all(blocks: Column) -> Column:
    odd = F.exists(blocks, lambda b: b.rlike(OTHER_ENTITY))
    return F.coalesce(_unescape_all(F.when(odd, blocks)), F.transform(blocks, plain_unescape))


def words(c: Column) -> Column:
    """Tokens of a normalised title; an empty title has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def title_case(c: Column) -> Column:
    """Capitalise after every non-letter: `mm2pets` becomes `Mm2Pets`, where initcap would give `Mm2pets`."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), ""
    )


def title_from_handle(handle: Column) -> Column:
    return title_case(strip(F.regexp_replace(F.replace(handle, F.lit("-"), F.lit(" ")), f"{SPACE}+", " ")))


def category_from_url(url: Column) -> Column:
    """Category named by the collection part of a listing url, null when there is none."""
    return title_from_handle(blank_to_null(F.regexp_extract(url, r"/collections/([^/?#]+)", 1)))


def english_text(value: Column) -> Column:
    """Of a title like `<local> - <English>`, the last part with a Latin letter."""

    def pick(text):
        latin = F.filter(F.transform(F.split(text, " - "), strip), lambda p: p.rlike("[A-Za-z]"))
        return F.when(text.contains(" - "), F.coalesce(F.get(F.reverse(latin), F.lit(0)), text)).otherwise(text)

    return let(strip(unescape(F.coalesce(value, F.lit("")))), pick)


def english_category(value: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return let(english_text(value), lambda text: F.coalesce(known[text], blank_to_null(text)))


def first_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """`df` without `text`, with the first group of each pattern's first match, unescaped; null when absent or empty.

    Case is ignored and the dot matches newlines. The text is dropped before entities are resolved, so it is never
    buffered for the Python stage.
    """
    found = {n: blank_to_null(F.regexp_extract(text, "(?is)" + p, 1)) for n, p in patterns.items()}
    return df.withColumns(found).drop(text).withColumns({n: unescape(F.col(n)) for n in patterns})
