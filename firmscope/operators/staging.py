"""Tables between the steps of iterative operators, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-firmscope-", dir="/tmp")


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return (named or _own()).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
