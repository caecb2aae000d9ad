"""Session settings and the few helpers that need to look at the session."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "shelfwatch", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every job here assumes; `extra` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; where none is named, a folder inside the warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        local = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file"
        if local and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set and the warehouse is a machine-local folder")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, kind: str = "cut") -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read back.

    Later steps neither regrow its plan nor depend on the executors that computed it. A written table is used because
    `checkpoint()` computes its input a second time for the write, and because a table has sizes to plan joins with and
    columns to prune.
    """
    folder = scratch_path(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_distinct(df: DataFrame, keys: list[str], compute) -> DataFrame:
    """`df` joined to what `compute` makes of the distinct values of `keys`, a frame of those columns that may drop or repeat values.

    What is costly to tell of a text is told once per text, not once per row. What is told is written once, so that the join knows its size: few
    values travel to the rows, many are shuffled with them.
    """
    return with_values(df, keys, cut_lineage(compute(df.select(*keys).distinct())))


def with_values(df: DataFrame, keys: list[str], made: DataFrame) -> DataFrame:
    """`df` joined to `made` on `keys`, where nulls are values like others; other columns of `made` replace those of `df`."""
    added = [c for c in made.columns if c not in keys]
    found = made.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *added)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.drop(*added).join(found, same).drop(*[f"_of_{k}" for k in keys])


def tasks_for(df: DataFrame, rows_per_task: int, *others: DataFrame) -> int:
    """How many tasks a table that is about to grow needs: one per `rows_per_task` rows (with those of `others`), one per core at least.

    A compressed file says little about the rows in it, and nothing about the work that each of them makes.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(d.count() for d in (df, *others)) // rows_per_task))


def at(df: DataFrame, column: str, when) -> Column:
    """`when` as a literal of the column's own type.

    Comparing a TIMESTAMP_NTZ column with a TIMESTAMP literal casts the column and loses the parquet filter.
    """
    kind = df.schema[column].dataType.simpleString()
    return F.lit(str(when)).cast(kind)
