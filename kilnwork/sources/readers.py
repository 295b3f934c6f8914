"""Reading catalogues, pages, documents and solutions, and writing them; each a DataFrame over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions.text import is_canonical, safe_component

CATALOGUE = "id string, contestId int, index string, name string, rating int, tags array<string>, solvedCount bigint, url string"
ENVELOPE = "status string, comment string, result struct<problems: array<struct<contestId: int, index: string, name: string, rating: int, tags: array<string>>>, problemStatistics: array<struct<contestId: int, index: string, solvedCount: int>>>"
# Extensions of solution files.
SOLUTIONS = ("c", "cc", "cpp", "cxx", "cs", "go", "java", "js", "kt", "py", "rs", "txt")


def feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The problems and the statistics (with pos, their place) of a metadata feed; a feed whose status is not OK is an error."""
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    good = rows.filter(F.when(F.col("status") == "OK", True).otherwise(F.raise_error(F.concat(F.lit("metadata feed: "), F.coalesce("comment", "status", F.lit("no status"))))))
    problems = good.select(F.explode("result.problems").alias("p")).select("p.*")
    return problems, good.select(F.posexplode("result.problemStatistics").alias("pos", "s")).select("pos", "s.*")


def catalogue(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A stored catalogue. Strict: a file that cannot be read is an error; else what cannot be read is left out."""
    rows = spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows if strict else rows.filter("id IS NOT NULL")


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """(content_id, text, canonical) of the documents of a folder; names that are no ids, or not .json, are left out."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select("*", F.col("_metadata.file_name").alias("file"))
    rows = rows.select(F.regexp_replace("file", r"\.json$", "").alias("content_id"), F.col("value").alias("text"))
    return rows.filter(safe_component(F.col("content_id"))).withColumn("canonical", is_canonical(F.col("text")))


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """(stem, name, ext, mtime, content) of solution files; bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").load(path).select("content", F.col("modificationTime").alias("mtime"), F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).filter(F.col("ext").isin(*SOLUTIONS))
    return rows.select(F.substring_index("name", ".", 1).alias("stem"), "name", "ext", "mtime", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def solutions_of(rows: DataFrame, contest: str, index: str) -> DataFrame:
    """An item's solutions by the prefix of their names, the latest first."""
    return rows.filter(F.col("name").startswith(f"{contest}{index}.")).orderBy(F.col("mtime").desc(), "name")


def write_catalogue(rows: DataFrame, path: str) -> None:
    """One commit for the whole catalogue: readers see the old one or the new one."""
    rows.write.mode("overwrite").json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("content_kind").parquet(path)
