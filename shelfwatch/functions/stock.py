"""Stock text to status."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions.constants import IN_STOCK_PHRASES, OUT_OF_STOCK_PHRASES


def classify_stock(text: Column) -> Column:
    """Substring rules, out of stock first. `not available` is therefore in stock."""
    lowered = F.lower(text)

    def says(phrases):
        return reduce(or_, [F.contains(lowered, F.lit(p)) for p in phrases])

    return (
        F.when(says(OUT_OF_STOCK_PHRASES), "out_of_stock").when(says(IN_STOCK_PHRASES), "in_stock").otherwise("unknown")
    )
