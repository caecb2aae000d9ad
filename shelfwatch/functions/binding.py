"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, for expressions that need it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
