"""Catalogue joins and projections: items with their statistics, existence flags, labels, identity checks and list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_default(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: object, order: str | None = None) -> DataFrame:
    """Left rows with `value` of the right row of the same keys, `default` where there is none. Of several right rows the last by `order` wins."""
    pick = F.max_by(value, order) if order else F.max(value)
    build = right.groupBy(*keys).agg(pick.alias(value))
    return left.join(build, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_flag(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left rows, each once, with whether the right side holds their key."""
    held = right.select(*keys).distinct().withColumn("_held", F.lit(True))
    return left.join(held, keys, "left").withColumn(flag, F.col("_held").isNotNull()).drop("_held")


def catalogue(problems: DataFrame, statistics: DataFrame, concatenated_key: bool = False, base_url: str = "https://example.org/problemset/problem/") -> DataFrame:
    """The catalogue from the two arrays of the metadata feed: id, url, default tags, solved count 0 where statistics lack.

    problems: contestId, index, name, rating, tags; statistics: contestId, index, solvedCount and pos, its place in the feed. The join is on the pair;
    with concatenated_key on contestId followed by index, under which (921, '01') and (9210, '1') are one.
    """
    code = F.concat(F.col("contestId").cast("string"), F.col("index"))
    keys = ["_code"] if concatenated_key else ["contestId", "index"]
    stats = statistics.withColumn("_code", code)
    rows = with_default(problems.withColumn("_code", code), stats, keys, "solvedCount", 0, "pos")
    return rows.select(
        F.col("_code").alias("id"), "contestId", "index", "name", "rating", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "solvedCount",
        F.concat(F.lit(base_url), F.col("contestId").cast("string"), F.lit("/"), F.col("index")).alias("url"),
    )


def rated_count() -> Column:
    """How many items have a rating that is neither null nor 0."""
    return F.count_if(F.col("rating").isNotNull() & (F.col("rating") != 0))


def identities(rows: DataFrame) -> DataFrame:
    """(problem_code, contest_id, index) of rows with an integer contestId and a string index, by code."""
    whole = rows.filter(F.col("contestId").isNotNull() & F.col("index").isNotNull())
    return whole.select(F.concat(F.col("contestId").cast("string"), "index").alias("problem_code"), F.col("contestId").cast("string").alias("contest_id"), "index").orderBy("problem_code")


def identity_error(ids: DataFrame) -> DataFrame:
    """One row: `empty-catalogue`, `duplicate-problem-code` or null."""
    return ids.agg(F.count("*").alias("n"), F.countDistinct("problem_code").alias("distinct_codes")).select(
        F.when(F.col("n") == 0, "empty-catalogue").when(F.col("n") != F.col("distinct_codes"), "duplicate-problem-code").alias("error")
    )


def labelled(ids: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """id and label `id — name`; the id alone where no non-empty name is known. Of several names the last by `order` wins."""
    last = names.groupBy("id").agg(F.max_by("name", order).alias("name"))
    return ids.join(last, "id", "left").select("id", F.when(F.length("name") > 0, F.concat(F.col("id").cast("string"), F.lit(" — "), "name")).otherwise(F.col("id").cast("string")).alias("label"))


def contest_label(contest_id: Column) -> Column:
    return F.concat(F.lit("Contest "), contest_id.cast("string"))


def numeric_order(ids: DataFrame, column: str = "contest_id") -> DataFrame:
    """Distinct digit strings in the order of their numbers, then of their spelling."""
    return ids.select(column).distinct().orderBy(F.col(column).cast("long"), column)


def batches(rows: DataFrame, order: list[str], size: int = 8) -> DataFrame:
    """Adds batch, 0 for the first `size` rows in order, and so on.

    Ranks come from the counts of sorted ranges, so that no task orders all rows: the range partitions are sorted each for itself and their sizes added up.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    within = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_base")
    return ranged.join(F.broadcast(bases), "_part").withColumn("batch", F.floor((within + F.col("_base")) / size).cast("long")).drop("_part", "_id", "_base")


def listed(rows: DataFrame, rating: tuple[int, int] | None = None, solved: tuple[int, int] | None = None, tags: list[str] | None = None, name: str | None = None, order: list[Column] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The list view: rows within the ranges, with all the tags and the words in the name, sorted, one page."""
    if rating:
        rows = rows.filter(F.col("rating").between(*rating))
    if solved:
        rows = rows.filter(F.col("solvedCount").between(*solved))
    for tag in tags or []:
        rows = rows.filter(F.array_contains("tags", tag))
    if name:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    if order:
        rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit is not None else rows


def unexpected(requested: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Requested ids that are not expected; must be empty before a run begins."""
    return requested.join(expected, key, "left_anti").select(key).distinct()


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side holds, with the side; none where both hold the same set."""
    one = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    two = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return one.join(two, keys, "full").filter("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))
