"""Tables that are written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder for a local master that names none, as in tests, and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_ledgerline_dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = spark._ledgerline_dir = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return found


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
