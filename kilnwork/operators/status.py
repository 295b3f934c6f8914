"""Item states folded from an append-only log, incremental selection, reports and priority order.

An event is (content_kind, content_id, seq, status). `ready` stores a document and clears earlier marks; `known_absent` takes the
document away and leaves a mark; other states leave a mark and keep the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ready", "known_absent", "transient_failure", "invalid_structure", "pending")
RETRIED = ("transient_failure", "invalid_structure")


def fold(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row an item: visible (a document is stored) and marker (the last mark since it was stored, or null)."""
    keys = keys or ["content_kind", "content_id"]
    ready = F.max(F.when(F.col("status") == "ready", F.col("seq")))
    absent = F.max(F.when(F.col("status") == "known_absent", F.col("seq")))
    last = F.max(F.when(F.col("status") != "ready", F.struct("seq", "status")))
    rows = events.groupBy(*keys).agg(ready.alias("_r"), absent.alias("_a"), last.alias("_m"))
    since = F.coalesce("_r", F.lit(-1))
    return rows.select(*keys, (since > F.coalesce("_a", F.lit(-1))).alias("visible"), F.when(F.col("_m.seq") > since, F.col("_m.status")).alias("marker"))


def item_status(visible: Column, valid: Column, marker: Column) -> Column:
    """ready for a stored valid document, invalid_structure for a stored invalid one, else the mark, else pending."""
    return F.when(F.coalesce(visible, F.lit(False)), F.when(valid, "ready").otherwise("invalid_structure")).otherwise(F.coalesce(marker, F.lit("pending")))


def selected(visible: Column, valid: Column, marker: Column, wanted: Column, force: bool = False) -> Column:
    """Whether a run takes the item up: forced or asked for; marked as failed, even while readable; or neither readable nor known absent."""
    failed = F.coalesce(marker.isin(*RETRIED), F.lit(False))
    readable = F.coalesce(visible & valid, F.lit(False))
    absent = F.coalesce(marker == "known_absent", F.lit(False))
    return F.lit(force) | F.coalesce(wanted, F.lit(False)) | failed | (~readable & ~absent)


def pending(expected: DataFrame, folded: DataFrame, key: str = "content_id", requested: list | None = None, force: bool = False, validate: bool = False) -> DataFrame:
    """The expected ids that a run takes up. folded: key, visible, marker and, with validate, valid."""
    valid = F.coalesce("valid", F.lit(False)) if validate else F.lit(True)
    wanted = F.col(key).isin(*requested) if requested else F.lit(False)
    rows = expected.join(folded, key, "left")
    return rows.filter(selected(F.col("visible"), valid, F.col("marker"), wanted, force)).select(*expected.columns)


def histogram(states: DataFrame, column: str = "status") -> DataFrame:
    """A count for each of the five states, 0 where none has it."""
    domain = states.sparkSession.createDataFrame([(s,) for s in STATUSES], f"{column} string")
    return domain.join(states.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def report(results: DataFrame, states: DataFrame) -> DataFrame:
    """One row: attempted, published, known absent and failed results of a run, and whether nothing is left to do."""
    run = results.agg(
        F.count("*").alias("attempted_count"), F.count_if(F.col("status") == "ready").alias("published_count"), F.count_if(F.col("status") == "known_absent").alias("known_absent_count"),
        F.count_if(F.col("status").isin(*RETRIED)).alias("failed_count"),
    )
    left = states.agg(F.count("*").alias("expected_count"), F.count_if(~F.col("status").isin("ready", "known_absent")).alias("_left"))
    return run.crossJoin(left).withColumn("completed", (F.col("failed_count") == 0) & (F.col("_left") == 0)).drop("_left")  # one row with one row


def progress(rows: DataFrame) -> DataFrame:
    """Done, total and failed summed over kinds, a row each and one for all (kind null); fetched is done."""
    return rows.rollup("kind").agg(F.sum("done").alias("done"), F.sum("total").alias("total"), F.sum("failed").alias("failed")).withColumn("fetched", F.col("done"))


def queue_ranks(pushes: DataFrame, by: str = "content_id") -> DataFrame:
    """The queue after pushes (seq, pos, id): the last batch first, within a batch the first mention first; each id once."""
    batch = pushes.groupBy(by, "seq").agg(F.min("pos").alias("pos"))
    return batch.groupBy(by).agg(F.max(F.struct("seq", (-F.col("pos")).alias("p"))).alias("_at")).select(by, F.col("_at.seq").alias("batch"), (-F.col("_at.p")).alias("pos"))


def ordered(pending_rows: DataFrame, ranks: DataFrame, by: str, catalogue_order: list[Column]) -> DataFrame:
    """Pending ids, queued ones first in the queue's order, then the others in the catalogue's."""
    return pending_rows.join(ranks, by, "left").orderBy(F.col("batch").desc_nulls_last(), F.col("pos").asc_nulls_last(), *catalogue_order)


def preview(pending_rows: DataFrame, ranks: DataFrame, names: DataFrame, by: str = "content_id") -> DataFrame:
    """(id, label, place) of pending ids in the order that a run would take them; names: (id, name), the label falls back to the id."""
    place = F.row_number().over(Window.orderBy(F.col("batch").desc_nulls_last(), F.col("pos").asc_nulls_last(), by))
    rows = pending_rows.join(ranks, by, "left").withColumn("place", place)
    label = F.when(F.length("name") > 0, F.concat(F.col(by).cast("string"), F.lit(" — "), "name")).otherwise(F.col(by).cast("string"))
    return rows.join(names.withColumnRenamed("id", by), by, "left").select(F.col(by).alias("id"), label.alias("label"), "place")


def popped(remaining: DataFrame, ranks: DataFrame, by: str = "content_id") -> DataFrame:
    """The first queued id that still remains, one row with its batch and pos, or none; ids queued ahead of it are stale."""
    return ranks.join(remaining.select(by), by, "left_semi").orderBy(F.col("batch").desc(), "pos", by).limit(1)
