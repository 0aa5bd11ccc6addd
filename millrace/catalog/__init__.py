"""Registered queries of the analytics operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL where there is one."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


from . import aggregates, inference, joins, models, monitoring, rows, screens, time  # noqa: E402, F401, I001
from . import comparisons, sources  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, orders and rank of each nation and segment over a four-table join path."""
    return QUERIES["j03_join_path"](spark, sf_dir)
