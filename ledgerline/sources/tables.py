"""Scans of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


#: Estimated bytes of a table up to which it is dealt out before text work.
SMALL = 1 << 28


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: a file of one row group is a single task otherwise. Larger tables stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
