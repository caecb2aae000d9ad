"""Sequence-matcher ratios. Not expressible with built-ins (`levenshtein` is a different measure), so Arrow batches.

Both functions score each distinct input of a batch once and skip nulls, so callers null out what they already know.
They are declared non-deterministic although they are not: Spark then leaves a filter on a score above the scoring,
where it would otherwise push copies of the whole expression towards the scan.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _each_pair(left: pd.Series, right: pd.Series, score) -> pd.Series:
    known: dict = {}
    out = []
    for pair in zip(left, right):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = score(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of two texts; the order of the arguments matters."""
    return _each_pair(left, right, _ratio)


def _fuzzy_part(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """The better of 0.8 x whole-text ratio and 0.7 x best word-pair ratio."""

    def score(q, c):
        best = max((_ratio(a, b) for a in set(q.split()) for b in set(c.split())), default=0.0)
        return max(_ratio(q, c) * 0.8, best * 0.7)

    return _each_pair(query, candidate, score)


sequence_ratio = F.pandas_udf(_sequence_ratio, T.DoubleType()).asNondeterministic()
fuzzy_part = F.pandas_udf(_fuzzy_part, T.DoubleType()).asNondeterministic()
