"""A table that several branches of a plan read, computed once."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read again; where that is unset, kept by the executors and made anew if one is lost."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
