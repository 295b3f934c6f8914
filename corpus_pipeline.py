"""From raw documents to token shards, in five stages, each over all that the stage before it kept.

quality: documents that the pairwise ranking scores under its threshold go. near_duplicates: of each group of documents linked by
a word-shingle similarity of 0.8 or more the one with the smallest doc_id stays (of its rows one). decontaminate: documents that hold any phrase of
ten words of a benchmark item go. mix: documents are repeated or left out until each source has its target weight. tokens:
ids are written to shards with their index; a row a document written, from the files.

Rows are judged one by one, also where several have the same doc_id. Those with a null doc_id are judged by their text alone and are
nobody's duplicate. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import forest_join, mixing, positional, quality, token_shards
from kilnwork.llm.shared import numbered, table, written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, by_number = numbered(docs)
    classes = written(forest_join.row_classes(rows))
    gone = classes.filter("row <> class_row").select(F.col("row").alias("_row"))
    if by_number:  # the smallest row of a class need not have its smallest doc_id
        ids = rows.select(F.col("_row").alias("row"), "doc_id", F.xxhash64("text").alias("text"))
        first = classes.join(ids, "row").groupBy("class_row").agg(F.min(F.struct("doc_id", "text", "row")).alias("first"))
        gone = classes.select(F.col("row").alias("_row")).join(first.select(F.col("first.row").alias("_row")), "_row", "left_anti")
    return rows.hint("merge").join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = numbered(docs)
    found = positional.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = written(found.filter("n_hit > 0").select(F.col("doc_id").alias("_row")))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
