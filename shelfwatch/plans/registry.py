"""Name -> (Spark job, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.plans.fixtures import view


@dataclass
class Source:
    """The views of one data folder, as a job sees them."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def table(self, name: str) -> DataFrame:
        from shelfwatch.sources.tables import table

        return table(self.spark, self.folder, name)

    def sql(self, text: str) -> DataFrame:
        from shelfwatch.plans.fixtures import run_sql

        return run_sql(self.spark, self.folder, text)

    def view_of(self, name: str, **frames: DataFrame) -> DataFrame:
        from shelfwatch.plans.fixtures import view_of

        return view_of(self.spark, self.folder, name, **frames)

    def pages(self, text: str, name: str = "part") -> DataFrame:
        from shelfwatch.plans.fixtures import run_pages

        return run_pages(self.spark, self.folder, text, name)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    """Register a function of one `Source` under `name`."""

    def wrap(fn: Callable[[Source], DataFrame]):
        JOBS[name] = lambda spark, folder: fn(Source(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from shelfwatch.plans import detection, landing, listing, notifying, reporting, searching  # noqa: F401
