"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms and lookalike letters of other scripts become Latin ones (accents stay, words differ by them), digits and signs that stand for letters become
those letters, `l` and `i` are one letter, everything else is a blank. An Aho-Corasick automaton finds the lexicon's terms, whole
words or beginnings of words, in one pass; matches inside an exception phrase don't count. The weights found, divided by a
length that grows with the square root of the number of words, give the score through a logistic curve.

The lexicon is learnt from labelled documents: at most `SAMPLE` of each label, those with the smallest hash of their id. A term's weight
is the logarithm of how much oftener toxic documents use it; of a word and its beginnings the one with the
strongest evidence is kept.
Exception phrases are a term with a neighbouring word that clean documents of the sample have and toxic ones don't.

Defined cases: a null or blank text has no matches and gets the curve's lowest score; the hash of a null doc_id is null, such a row isn't held
out; rows with equal doc_id or text are scored each; without labels of both kinds every score is 0; extra columns are passed by.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import table
from shelfwatch.session import cut_lineage

#: Most labelled documents of each label that the lexicon is learnt from.
SAMPLE = 2500
#: Letters of other scripts and the Latin letter each looks like, and signs that stand for letters.
LOOKALIKES = dict(zip("авеіјкмнорѕтухԁһցԛԝαβεηικνορτυχ", "abeijkmhopstyxdhgqwabenikvoptux"))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))
INNER_SIGNS = re.compile(r"(?<=[a-z])[!|](?=[a-z])")
UNSEEN = "­​‌‍⁠﻿"
PREFIX_LENGTHS = range(5, 11)


class FoldTable(dict):
    """What each code point is folded to; one outside the ranges made at the start is folded when a text first has it."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        base = unicodedata.normalize("NFKC", c.lower()).lower()
        base = "".join(SUBSTITUTES.get(x, LOOKALIKES.get(x, x)) for x in base)
        base = "".join(x if x.isalnum() or x in "!|" else " " for x in base)
        base = base.replace("l", "i").replace("ß", "ss")
        self[point] = "" if c in UNSEEN or (unicodedata.combining(c) and not c.isalnum()) else base
        return self[point]


def fold_table() -> FoldTable:
    folded = FoldTable()
    for point in (*range(0x2200), *range(0x3000, 0x3040), *range(0xFF01, 0xFF5F), 0xFEFF):
        folded[point]
    return folded


def fold(text: str, table_: dict[int, str]) -> str:
    """Folded text with a blank at either end; only letters, digits and blanks are left."""
    made = text.translate(table_)
    if "!" in made or "|" in made:
        made = INNER_SIGNS.sub("i", made).replace("!", " ").replace("|", " ")
    return f" {' '.join(made.split())} "


@dataclass
class Lexicon:
    """Terms as they stand in folded text (`" word "` or `" begin"`) with weights, exception phrases, and the curve's two numbers."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    shift: float


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.table = lexicon, fold_table()
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), weight, term))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, phrase))
        if lexicon.weights:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) of the terms that count; of terms that start together the longest does."""
        if not self.lexicon.weights:
            return []
        found: dict[int, tuple[int, int, float, str]] = {}
        excepted: list[tuple[int, int]] = []
        for last, (length, weight, term) in self.automaton.iter(folded):
            start = last - length + 1
            if weight is None:
                excepted.append((start, last))
            else:
                found[start] = (start, last + 1, weight, term)
        if not excepted:
            return list(found.values())
        return [m for m in found.values() if not any(a <= m[0] and m[1] - 1 <= b for a, b in excepted)]

    def feature(self, text: str | None) -> tuple[float, int]:
        """The weight found over the text's length, and the number of matches."""
        folded = fold(text or "", self.table)
        hits = self.matches(folded)
        return sum(m[2] for m in hits) / math.sqrt(folded.count(" ") + 20.0), len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        value, hits = self.feature(text)
        if not self.lexicon.weights:
            return 0.0, 0
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.lexicon.slope * value + self.lexicon.shift)))), hits


def terms_of(text: str | None, table_: dict[int, str]) -> Counter:
    """How often each word of a folded text and each beginning of a word occurs, as lexicon terms; the words in all as ""."""
    words, terms = Counter(fold(text or "", table_).split()), Counter()
    for word, n in words.items():
        if not word.isdigit():
            if len(word) > 2:
                terms[f" {word} "] += n
            for length in PREFIX_LENGTHS:
                if len(word) >= length:
                    terms[f" {word[:length]}"] += n
    terms[""] = words.total()
    return terms


def term_counts(sample: DataFrame, known: list[str] | None) -> DataFrame:
    """(term, n, docs): occurrences in the sample and documents that have it; of `known` terms only, where they are given."""
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(known) if known is not None else None)

    def run(batches):
        table_, counts, docs = fold_table(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = terms_of(text, table_)
                if shared.value is not None:
                    terms = Counter({t: terms[t] for t in terms.keys() & shared.value})
                counts.update(terms)
                docs.update(terms.keys())
        items = list(counts.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"term": [t for t, _ in part], "n": pa.array([n for _, n in part], pa.int64()), "docs": pa.array([docs[t] for t, _ in part], pa.int64())})

    counted = sample.select("text").mapInArrow(run, "term string, n long, docs long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], least_weight: float, least_evidence: float) -> dict[str, float]:
    """Weights of the terms worth keeping; both counts have the number of words in all under the empty term.

    Evidence is the log-likelihood ratio of a term's two rates against one common rate. Terms are taken by falling evidence, and
    of those that begin with each other only the first.
    """
    words, others = toxic[""] + 1, clean.get("", 0) + 1
    weight, evidence = {}, {}
    for term, n in toxic.items():
        m = clean.get(term, 0)
        common = (n + m) / (words + others)
        weight[term] = math.log((n + 0.5) / words) - math.log((m + 0.5) / others)
        evidence[term] = 2 * (n * math.log(n / words / common) + (m * math.log(m / others / common) if m else 0.0))
    chosen: dict[str, float] = {}
    parts: set[str] = set()  # of chosen terms, the beginnings long enough to be terms
    for term in sorted((t for t in toxic if t), key=lambda t: (-evidence[t], t)):
        if weight[term] < least_weight or evidence[term] < least_evidence:
            continue
        beginnings = {term[:n] for n in range(min(PREFIX_LENGTHS) + 1, len(term) + 1)} | {term}
        if term not in parts and not beginnings & chosen.keys():
            chosen[term] = round(weight[term], 6)
            parts |= beginnings
    return chosen


def fit_curve(values: np.ndarray, labels: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps with a little shrinkage; the slope is not negative."""
    x, theta = np.stack([values, np.ones(len(values))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1
        theta = theta - np.linalg.solve(hessian, x.T @ (p - labels) + 0.1 * theta)
    return max(0.0, float(theta[0])), float(theta[1])


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, least_docs: int = 3, least_share: float = 0.01, least_weight: float = 1.5, least_evidence: float = 36.0, most_terms: int = 50_000) -> Lexicon:
    """A lexicon from labelled documents; `labels` has (doc_id, toxic) and only rows that may be learnt from.

    What reaches the driver is bounded by the parameters: the ids of the sample, `most_terms` terms, one number per sampled document.
    """
    spark = docs.sparkSession
    chosen = []
    for value in (1, 0):
        of = labels.where((F.col("toxic") == value) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(value).alias("toxic"))
        chosen.append(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_size))
    ids = chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most 2 * sample_size rows
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, (), 0.0, 0.0)
    frequent = term_counts(sample.where("toxic = 1"), None).where(F.col("docs") >= max(least_docs, least_share * sizes[1])).orderBy(F.col("n").desc(), "term").limit(most_terms)
    toxic = {r["term"]: r["n"] for r in frequent.collect()}
    clean = {r["term"]: r["n"] for r in term_counts(sample.where("toxic = 0"), list(toxic)).collect()}
    weights = choose_terms(toxic, clean, least_weight, least_evidence)
    first = spark.sparkContext.broadcast(Lexicon(weights, (), 0.0, 0.0))

    def neighbours(batches):
        matcher, counts = Matcher(first.value), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                folded = fold(text or "", matcher.table)
                for start, end, _, _ in matcher.matches(folded):
                    stop = folded.index(" ", start + 1)
                    if (before := folded.rfind(" ", 0, start)) >= 0:
                        counts[folded[before : stop + 1], label] += 1
                    if (after := folded.find(" ", stop + 1)) >= 0:
                        counts[folded[start : after + 1], label] += 1
        yield pa.RecordBatch.from_pydict({"phrase": pa.array([k[0] for k in counts], pa.string()), "toxic": pa.array([k[1] for k in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    phrases = sample.select("text", "toxic").mapInArrow(neighbours, "phrase string, toxic int, n long").groupBy("phrase")
    phrases = phrases.agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.max("toxic").alias("toxic"))
    phrases = phrases.where((F.col("toxic") == 0) & (F.col("clean") >= least_docs)).orderBy(F.col("clean").desc(), "phrase").limit(most_terms)
    exceptions = tuple(r["phrase"] for r in phrases.collect())
    second = spark.sparkContext.broadcast(Lexicon(weights, exceptions, 0.0, 0.0))

    def features(batches):
        matcher = Matcher(second.value)
        for batch in batches:
            values = [matcher.feature(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column(1).cast(pa.int32())], names=["value", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(features, "value double, toxic int").orderBy("value", "toxic").collect()
    slope, shift = fit_curve(np.array([r["value"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return Lexicon(weights, exceptions, slope, shift)


def score_documents(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """`keep`, score and the number of matches of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                made = [matcher.score(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int64())], names=[*keep, "score", "n_matches"])

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kept_types}, score double, n_matches long")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, as they are, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([matcher.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(spark: SparkSession, folder: str, docs: DataFrame) -> Lexicon:
    return learn_lexicon(docs, table(spark, folder, "labels").where(~held_out(F.col("doc_id"))))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_documents(docs, learn_from(spark, folder, docs), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")
