"""What several of the operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of anything but space and the five ASCII control spaces.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of blank-separated words; 0 for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANK_RUN))).otherwise(0).cast("long")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for values that only save work when they are found again."""
    holder = sys.modules.setdefault("shelfwatch_worker_store", types.ModuleType("shelfwatch_worker_store"))
    return holder.__dict__.setdefault("store", {})


def slices(texts, most_chars: int):
    """Runs of consecutive texts of about `most_chars` characters, at least one text each, with the index of the first."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        if part and size + len(text) > most_chars:
            yield first, part
            first, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield first, part
