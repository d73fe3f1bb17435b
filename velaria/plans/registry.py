"""The table of named queries: each with its DataFrame, most with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an inventory id and, where SQL can say it, its statement."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many tasks as there are cores, for work that is heavy per row.

    A table in many files already is, and is left alone; one in few files is dealt out, whatever its size: a
    Parquet file may be cut in many splits of which only one holds rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(df.rdd.getNumPartitions(), len(df.inputFiles()))
    return df.repartition(cores) if parts < cores else df
