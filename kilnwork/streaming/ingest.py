"""Beyond the batch operators: pages that arrive as files become states in an event log, batch by batch, exactly once.

Every micro-batch maps its pages, and appends the results under the batch's own number; a batch that runs again after a failure
overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kilnwork.operators import lifecycle

PAGES = "doc_id long, url string, html string"


def pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Runs until all files that are there have been taken up."""

    def batch(rows: DataFrame, number: int) -> None:
        out = lifecycle.statement_results(rows).withColumn("seq", F.lit(number).cast("long"))
        out.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).select("content_kind", "content_id", "seq", "status", "evidence")
