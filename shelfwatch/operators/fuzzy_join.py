"""All pairs of texts whose sequence ratio reaches a threshold, without comparing all pairs.

A ratio is 2 * M / (len a + len b) with M the characters in matching blocks. A ratio of `least` asks for m = least * (len a + len b) / 2 of them, which
leaves u = len a + len b - 2 * m unmatched; so there are u + 1 blocks at most, and the texts share m - (q - 1) * (u + 1) q-grams at least, repeats counted. Everything
below follows from that bound and loses no pair:

* lengths: the shorter text must have m characters;
* prefixes: of two texts that share t of their grams, the rarest `len - t + 1` of each have one in common, so only those are joined on;
* positions: a shared gram is moved by no more than the unmatched characters of the longer text;
* counts: joined pairs must share t grams in all, and m letters, before the ratio is computed.

A pair uses the longest grams, of three characters at most, of which it must share one; short pairs and low thresholds need shorter ones, down to letters. A
gram that very many texts have is dealt to cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.similarity import sequence_ratio
from shelfwatch.functions.text import words

#: A gram that more texts have is dealt to cells of about so many.
CELL = 20_000


def least_matched(total: Column, least: float) -> Column:
    """The characters that texts of this total length must match for the ratio."""
    return F.ceil(total * F.lit(least / 2) - F.lit(1e-9)).cast("int")


def least_grams(total: Column, q: Column, least: float) -> Column:
    m = least_matched(total, least)
    return m - (q - 1) * (1 + total - 2 * m)


def gram_length(total: Column, least: float) -> Column:
    """The length of the grams by which texts of this total length are joined."""
    return F.when(least_grams(total, F.lit(3), least) > 0, 3).when(least_grams(total, F.lit(2), least) > 0, 2).otherwise(1)


def numbered_grams(text: Column, q: Column) -> Column:
    """(gram, pos) of a text's q-grams; a gram that occurs again is numbered, so that equal ones are told apart."""
    plain = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q))
    every = F.transform(plain, lambda g, i: F.struct(
        F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda h: h == g)).cast("string")).alias("gram"), i.alias("pos")))
    return F.when(F.length(text) >= q, every).otherwise(F.slice(F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("pos"))), 1, 0))


def shared_letters(a: Column, b: Column) -> Column:
    """How many characters two texts share, whatever their order."""
    def count(text, letter):
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    letters = F.array_distinct(F.split(a, ""))
    return F.aggregate(letters, F.lit(0), lambda n, x: n + F.when(x != "", F.least(count(a, x), count(b, x))).otherwise(0))


def _grams(texts: DataFrame, least: float) -> DataFrame:
    """(text, q, gram, pos, rank, keep): the grams of every text, rare ones first, and how many of them are joined on."""
    n = F.length("text")
    # the lengths a partner may have: 2 * min / (sum of both) must reach `least`
    low, high = F.ceil(n * F.lit(least / (2 - least)) - F.lit(1e-9)).cast("int"), F.floor(n * F.lit((2 - least) / least) + F.lit(1e-9)).cast("int")
    sized = texts.where(n > 0).withColumn("partners", F.sequence(low, high))
    kinds = sized.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn(
        "partners", F.filter("partners", lambda p: gram_length(n + p, least) == F.col("q")))
    kinds = kinds.where((F.size("partners") > 0) & (n >= F.col("q")))
    kinds = kinds.withColumn("fewest", F.array_min(F.transform("partners", lambda p: least_grams(n + p, F.col("q"), least))))
    single = kinds.select("text", "q", "fewest", F.explode(numbered_grams(F.col("text"), F.col("q"))).alias("g")).select("text", "q", "fewest", "g.*")
    return single.withColumn("keep", F.length("text") - F.col("q") + 1 - F.col("fewest") + 1)


def _prefixes(grams: DataFrame, frequency: DataFrame) -> DataFrame:
    """(text, q, gram, pos, n): the rarest grams of every text; a group is the grams of one text."""
    counted = grams.join(frequency, ["q", "gram"])
    whole = counted.groupBy("text", "q", "keep").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "pos"))).alias("grams"))
    first = whole.select("text", "q", F.explode(F.slice("grams", F.lit(1), F.col("keep"))).alias("g"))
    return first.select("text", "q", "g.*")


def candidate_pairs(left: DataFrame, right: DataFrame, least: float, cell: int = CELL) -> DataFrame:
    """(a, b), distinct and different, of `left` (text) and `right` (text): all that may reach the ratio, and some more."""
    one, other = (_grams(t.select("text").where("text is not null").distinct(), least) for t in (left, right))
    frequency = one.select("q", "gram").unionByName(other.select("q", "gram")).groupBy("q", "gram").agg(F.count("*").alias("n"))
    cells = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    a = _prefixes(one, frequency).select("q", "gram", F.col("text").alias("a"), F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    b = _prefixes(other, frequency).select("q", "gram", F.col("text").alias("b"), F.col("pos").alias("j"), F.pmod(F.xxhash64("text"), cells).cast("int").alias("cell"))
    total = F.length("a") + F.length("b")
    m = least_matched(total, least)
    met = a.join(b, ["q", "gram", "cell"]).where(F.col("a") != F.col("b"))
    met = met.where(F.col("q") == gram_length(total, least))
    met = met.where((F.least(F.length("a"), F.length("b")) >= m) & (F.abs(F.col("i") - F.col("j")) <= F.greatest(F.length("a"), F.length("b")) - m))
    pairs = met.select("a", "b", "q").distinct()
    named = [F.transform(numbered_grams(F.col(c), F.col("q")), lambda g: g["gram"]) for c in ("a", "b")]
    enough = F.size(F.array_intersect(*named)) >= least_grams(total, F.col("q"), least)
    return pairs.where(enough).where(shared_letters(F.col("a"), F.col("b")) >= m).select("a", "b")


def similar_texts(left: DataFrame, right: DataFrame, least: float, cell: int = CELL) -> DataFrame:
    """(a, b, ratio): the pairs of different texts of `left` (text) and `right` (text) whose ratio is `least` or more."""
    scored = candidate_pairs(left, right, least, cell).withColumn("ratio", sequence_ratio(F.col("a"), F.col("b")))
    return scored.where(F.col("ratio") >= least)


def contained_texts(left: DataFrame, right: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): different texts where `b` has every word of `a`, and `a` has two words or more. Joined on the rarest word of `a`."""
    split = lambda t, name: t.select(F.col("text").alias(name)).where("text is not null").distinct().withColumn("w", F.array_distinct(words(F.col(name))))
    holders = split(right, "b").select("b", F.explode("w").alias("word"))
    frequency = holders.groupBy("word").agg(F.count("*").alias("n"))
    asked = split(left, "a").where(F.size(words(F.col("a"))) > 1)
    # a word that no text has rules every pair out
    rarest = asked.select("a", F.explode("w").alias("word")).join(frequency, "word", "left").groupBy("a").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).select("a", "r.*").where("n > 0")
    cells = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    a = rarest.select("a", "word", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    b = holders.join(frequency, "word").select("b", "word", F.pmod(F.xxhash64("b"), cells).cast("int").alias("cell"))
    met = a.join(b, ["word", "cell"]).where(F.col("a") != F.col("b"))
    return met.where(F.size(F.array_except(words(F.col("a")), words(F.col("b")))) == 0).select("a", "b")
