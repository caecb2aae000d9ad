"""From raw documents to encoded training data, stage by stage.

Every stage takes what the one before kept. All but the last return the columns of `documents`; further columns are carried along, whatever
their names. Rows with a null doc_id, null or empty texts are kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.bpe import encode_checked, tokenizer_file
from shelfwatch.llm.mixing import plan_mix, training_order
from shelfwatch.llm.neardup import near_duplicates
from shelfwatch.llm.substrings import without_repeats
from shelfwatch.llm.toxicity import learn_from, without_toxic
from shelfwatch.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learnt from the labels that aren't held out."""
    return without_toxic(docs, learn_from(spark, sf_dir, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, likeness 0.8) the document with the smallest doc_id stays.

    Rows with one doc_id and different texts are documents of their own, in the order of a hash of their texts; of equal rows (doc_id and
    text) one stays. Rows with a null doc_id and null or blank texts stay, once for each doc_id.
    """
    known = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        dropped = near_duplicates(docs, size=5, percent=80).where(~F.col("kept")).select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    # every (doc_id, text) gets a number of its own, in the order of doc_id
    ordered = known.distinct().sort("doc_id", "h").withColumn("n", F.monotonically_increasing_id())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h"))
    numbers = cut_lineage(ordered).withColumnRenamed("doc_id", "id")
    numbered = packed.where("id is not null").join(numbers, ["id", "h"]).withColumn("copy", F.row_number().over(Window.partitionBy("n").orderBy("h")))
    single = cut_lineage(numbered.where("copy = 1").select("row", "n", "text"))
    dropped = near_duplicates(single.select(F.col("n").alias("doc_id"), "text"), size=5, percent=80).where(~F.col("kept"))
    left = single.join(dropped.select(F.col("doc_id").alias("n")), "n", "left_anti").select("row.*")
    return left.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur more than once are cut out; n_chars follows the text.

    A document of which a cut leaves only blanks goes; null, empty and blank texts that nothing is cut from stay. Equal rows repeat each other: where
    their texts have 200 bytes, both go.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("others"), "text", F.col("text").isNull().alias("missing"))
    cut = without_repeats(packed, ["others", "missing"])
    text = F.when(~F.col("missing"), F.col("text"))
    values = {c: F.col(f"others.`{c}`") for c in others}
    if "n_chars" in values:
        values["n_chars"] = F.when(values["n_chars"].isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select([text.alias("text") if c == "text" else values[c].alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null, empty and blank texts have no words, so the mix takes none of them; a null source is a source of its own. Rows with equal or null doc_id are
    rows of their own, and ties of position are in the order of the md5 of doc_id.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    return training_order(plan_mix(packed), ["row"]).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to.

    One row for every row: doc_id, source and lang as they are, null or repeated; a null text is encoded as an empty one, without ids. Other columns are
    left out.
    """
    return encode_checked(docs.select("doc_id", "source", "lang", "text"), tokenizer_file("byte_bpe_50k.json"), ["doc_id", "source", "lang"])


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing to target weights", mixing),
    ("bpe encoding and decoding", bpe),
]

#: SQL has no learnt lexicon, signatures or merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
