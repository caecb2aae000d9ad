"""Price text to (price, currency)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.constants import CURRENCY_CODES, CURRENCY_SYMBOLS

# Every decimal digit of Unicode with its ASCII counterpart, built by rule.
_DIGITS = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
_OTHER_DIGITS = "".join(_DIGITS)
_ASCII_DIGITS = "".join(str(unicodedata.digit(d)) for d in _DIGITS)


def with_price(df: DataFrame, raw: Column, default_currency: Column | str = "USD") -> DataFrame:
    """`df` with columns price decimal(12,2) and currency. Negative or unreadable prices are null, the currency stays.

    Written as a chain of small projections: each step is used several times by the next, so Catalyst keeps them apart
    and every step is computed once per row.
    """
    default = F.lit(default_currency) if isinstance(default_currency, str) else default_currency
    t, rest, named, digits = (F.col(c) for c in ("_text", "_rest", "_code", "_digits"))
    df = df.withColumns({"_text": F.coalesce(raw, F.lit("")), "_default": default})

    symbol = F.lit("")
    for mark, _ in reversed(CURRENCY_SYMBOLS):
        symbol = F.when(F.contains(t, F.lit(mark)), F.lit(mark)).otherwise(symbol)
    df = df.withColumn("_symbol", symbol)
    df = df.withColumn("_rest", F.when(F.col("_symbol") == "", t).otherwise(F.replace(t, F.col("_symbol"), F.lit(""))))
    df = df.withColumn("_upper", F.upper(rest))
    code = F.lit("")
    for name in reversed(CURRENCY_CODES):
        code = F.when(F.contains(F.col("_upper"), F.lit(name)), F.lit(name)).otherwise(code)
    ascii_rest = F.when(rest.rlike(r"[^\x00-\x7F]"), F.translate(rest, _OTHER_DIGITS, _ASCII_DIGITS)).otherwise(rest)
    df = df.withColumns({"_code": code, "_digits": F.regexp_replace(ascii_rest, "[^0-9.,-]", "")})

    comma, dot = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    number = (
        F.when(comma & dot & digits.rlike(",[^.]*$"), F.translate(digits, ",.", "."))
        .when(comma & ~dot & digits.rlike("^[^,]*,[^,]{0,2}$"), F.translate(digits, ",", "."))
        .otherwise(F.translate(digits, ",", ""))
    )
    by_symbol = F.col("_default")
    for mark, name in CURRENCY_SYMBOLS:
        by_symbol = F.when(F.col("_symbol") == mark, F.lit(name)).otherwise(by_symbol)
    df = df.withColumns({
        "_number": number.try_cast("decimal(12,2)"),
        "currency": F.when(t == "", F.col("_default")).when(named != "", named).otherwise(by_symbol),
    })
    return df.withColumn("price", F.when(F.col("_number") >= 0, F.col("_number"))).drop(
        "_text", "_default", "_symbol", "_rest", "_upper", "_code", "_digits", "_number"
    )


def money(price: Column, currency: Column, signs: dict[str, str]) -> Column:
    """`$1,234.50`; an unknown currency is written as its code, a missing price as N/A."""
    sign = F.concat(currency, F.lit(" "))
    for code, mark in signs.items():
        sign = F.when(currency == code, F.lit(mark)).otherwise(sign)
    return F.when(price.isNull(), F.lit("N/A")).otherwise(F.concat(sign, F.format_number(price, 2)))
