"""Mixing sources to target weights by capped water-filling.

Every source gets the share of the total size that its weight asks for, but no more than `max_epochs` times its own size; what is
cut off is shared out again among the others by weight until no target lies above its cap. Sorted by cap/weight, the level of
the water is the largest of (total - caps so far) / (weights left), so one window over the sources finds it.

A source whose target is r times its size gives every document floor(r) times, and once more the documents that come first in a
seeded order until the rest of the target is met; up to CLOSERS more documents, each the one whose size is nearest to what is
still missing, close the gap. Only (source, size, hash) is ever ordered: totals of hash ranges find the range where the cut falls, and a
window orders the documents of that range alone, so that a source with most of the rows is never in one task. There are so many ranges
that one holds about RANGE_ROWS rows of the largest source.

Equal hashes are told apart by a copy number, counted within each partition of the rows and on from partition to partition; which of
some equal rows has which number is open, but the numbers themselves, and with them the result, do not depend on the partitions.

Defined results: null and empty texts have size 0 and are taken 0 times over; a null source is a source, after all others; equal
rows are documents of their own; a null doc_id is a value like others; an empty table gives no rows; further columns pass
through apply_mix() (names that begin with `mix_` are used by it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnwork.llm.shared import table, written

MAX_EPOCHS = 3
#: Documents that close a source's gap, at most.
CLOSERS = 3
#: Plans with at most so many sources are broadcast (about 100 bytes a source).
BROADCAST_SOURCES = 50_000
#: Rows in a range of hashes; ranges are 2**LEAST_BITS at least.
RANGE_ROWS, LEAST_BITS = 100_000, 10


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Adds mix_size (words of a text) and mix_hash (its place in the seeded order). Equal rows have equal hashes: see told_apart()."""
    # each run becomes one character, so no list of the words is made
    marks = F.translate(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\x0c\r", "")
    return docs.withColumns({"mix_size": F.coalesce(F.length(marks), F.lit(0)).cast("long"), "mix_hash": F.xxhash64(F.lit(seed), "doc_id", "text")})


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with a mix_hash of each one's own. Where all differ already, as with distinct doc_ids, they are given back as they are."""
    twice = rows.groupBy("mix_hash").agg(F.count("*").alias("n")).filter("n > 1").select("mix_hash")
    if twice.limit(1).count() == 0:
        return rows
    rows = written(rows.withColumn("mix_part", F.spark_partition_id()))
    twice = written(twice)
    again = rows.join(twice, "mix_hash", "left_semi")
    parts = again.groupBy("mix_hash", "mix_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_hash").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("mix_hash", "mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_base"))
    place = F.row_number().over(Window.partitionBy("mix_hash", "mix_part").orderBy(F.lit(0))) - 1 + F.col("mix_base")
    again = again.join(base, ["mix_hash", "mix_part"]).withColumn("mix_place", place)
    again = again.withColumn("mix_hash", F.when(F.col("mix_place") > 0, F.xxhash64("mix_hash", "mix_place")).otherwise(F.col("mix_hash")))
    # written, as the numbers of equal rows must be the same each time that they are read
    return written(rows.join(twice, "mix_hash", "left_anti").unionByName(again.select(rows.columns)).drop("mix_part"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with weights 1, 2, 3, repeating, by code point: adds weight and target. One row a source."""
    ranked = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("weight", ((F.row_number().over(ranked) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", level)
        .withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def plan_mix(slim: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """From (source, mix_size, mix_hash): one row a source with target, whole (repetitions of all), upto (the place of the last document with one more) and also (hashes of those that close the gap)."""
    largest = slim.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(40, max(LEAST_BITS, (largest // RANGE_ROWS).bit_length()))
    at = F.shiftrightunsigned("mix_hash", 64 - bits)
    ordered = slim.select("source", "mix_size", F.col("mix_hash"), at.alias("at"))
    totals = written(ordered.groupBy("source", "at").agg(F.sum("mix_size").alias("size")))
    targets = water_fill(totals.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = written(targets.withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn("quota", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("at"))
    t = targets.select(F.col("source").alias("s"), "quota")
    cut = (
        totals.withColumn("end", upto)
        .join(t, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("end") > F.col("quota")) & (F.col("end") - F.col("size") <= F.col("quota")))
        .groupBy("source")
        .agg(F.min("at").alias("cut_at"), F.min(F.col("end") - F.col("size")).alias("base"), F.first("quota").alias("quota"))
    )
    cut = written(cut)
    c = cut.select(F.col("source").alias("s"), "cut_at", "base", "quota")
    small = c.count() <= BROADCAST_SOURCES
    c = F.broadcast(c) if small else c
    inside = ordered.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("cut_at")))
    run = F.col("base") + F.sum("mix_size").over(Window.partitionBy("source").orderBy(F.col("mix_hash").bitwiseXOR(F.lit(-(2**63)))).rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("run", run).filter(F.col("run") <= F.col("quota")).groupBy("source").agg(F.max(F.struct("run", F.col("mix_hash").bitwiseXOR(F.lit(-(2**63))).alias("key"))).alias("last"))
    # the seeded order is that of the hash read as unsigned: `key` is the hash with its sign turned
    floor_key = F.when(F.col("cut_at") > 0, F.shiftleft("cut_at", 64 - bits).bitwiseXOR(F.lit(-(2**63))) - 1)
    ends = c.join(last.withColumnRenamed("source", "ls"), F.col("s").eqNullSafe(F.col("ls")), "left").select(
        "s", F.coalesce("last.key", floor_key).alias("upto"), (F.col("quota") - F.coalesce("last.run", "base")).alias("gap")
    )
    ends = written(ends.withColumn("also", F.array().cast("array<long>")))
    key = F.col("mix_hash").bitwiseXOR(F.lit(-(2**63)))
    off = F.abs(F.col("mix_size") - F.col("gap"))
    for _ in range(CLOSERS):  # each time the document nearest in size to what is still missing, if it brings the total nearer
        e = F.broadcast(ends) if small else ends
        left = ordered.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto").isNull() | (key > F.col("upto"))))
        fits = left.filter((F.col("mix_size") > 0) & (off < F.col("gap")) & ~F.array_contains("also", F.col("mix_hash")))
        near = fits.groupBy(F.col("source").alias("ns")).agg(F.min(F.struct(off.alias("off"), F.col("mix_hash").alias("hash"), F.col("mix_size").alias("size"))).alias("next"))
        also = F.when(F.col("next").isNull(), F.col("also")).otherwise(F.array_append("also", F.col("next.hash")))
        ends = written(
            ends.join(near, F.col("s").eqNullSafe(F.col("ns")), "left").select("s", "upto", (F.col("gap") - F.coalesce("next.size", F.lit(0))).alias("gap"), also.alias("also"))
        )
    return (
        targets.join(ends.drop("gap"), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "whole", "upto", "also")
    )


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs as sized() gives them, with mix_repeats (times that a document is taken) and its source's mix_source_size and mix_target."""
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    key = F.col("mix_hash").bitwiseXOR(F.lit(-(2**63)))
    more = F.coalesce(key <= F.col("upto"), F.lit(False)) | F.coalesce(F.array_contains("also", F.col("mix_hash")), F.lit(False))
    times = F.when(F.col("mix_size") > 0, F.col("whole") + more.cast("long")).otherwise(0)
    return docs.join(plan, docs["source"].eqNullSafe(plan["mix_source"]), "left").withColumn("mix_repeats", times).drop("whole", "upto", "also", "mix_source")


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns of docs."""
    rows = told_apart(sized(docs, seed))
    slim = written(rows.select("source", "mix_size", "mix_hash"))
    out = apply_mix(rows, written(plan_mix(slim, max_epochs)))
    return out.filter("mix_repeats > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int")))).select(*[F.col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = told_apart(written(sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_size", "mix_hash")))
    return apply_mix(slim, written(plan_mix(slim))).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_repeats")).alias("taken"), "source"
    )
