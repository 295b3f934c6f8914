"""Where jobs keep what they write between steps, and how they read the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset and Spark runs in one process, as in tests, under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet, read again. A lost executor loses none of it."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def tidied() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at the end all that written() wrote inside, but for the tables handed to the function that it gives."""
    _scratch.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        forget(*[x for x in _scratch.pop() if all(x is not k for k in kept)])
        if _scratch:
            _scratch[-1] += kept


def forget(*tables: DataFrame) -> None:
    """Delete what written() wrote for these; nothing may read them any more."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `_row`, an id of each row's own, and whether that is a number: where every doc_id is there and on one row it is the doc_id, else rows are written with numbers."""
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1 OR doc_id IS NULL").limit(1).count() > 0
    return (written(docs.withColumn("_row", F.monotonically_increasing_id())), True) if odd else (docs.withColumn("_row", F.col("doc_id").cast("long")), False)


def remainder(column: str, by: int) -> F.Column:
    """crc32 of an id as text, modulo `by`: the fold that a row falls in. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, by: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled documents of each class, first by hash, none of the held-out fold.

    The chosen ids, at most 2 * per_class, are the only thing broadcast. Of rows with one doc_id one text is taken, the first by hash.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", by) != held_out)).distinct()
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("place"), "text")).alias("row")).select("doc_id", "row.text", "y")


def best_cut(scores, y, soft: float = 0.1) -> float:
    """The quantile of `scores` that parts the classes best: where the two rates of right answers add up to most.

    A score counts as right by a soft step of `soft` standard deviations, so that in a gap the cut lies well inside.
    """
    import numpy as np

    scores, y = np.asarray(scores, float), np.asarray(y)
    good, bad = scores[y == 1], scores[y == 0]
    if not len(good) or not len(bad):
        return float(scores.min() - 1) if len(scores) else 0.0
    width = soft * scores.std() + 1e-9
    tries = np.quantile(scores, np.linspace(0, 1, 401))
    tries = np.unique(np.concatenate([tries, (tries[1:] + tries[:-1]) / 2]))
    step = lambda x: 1 / (1 + np.exp(np.clip(x / width, -30, 30)))
    right = [step(t - good).mean() + step(bad - t).mean() for t in tries]
    return float(tries[int(np.argmax(right))])


def cut_of_counts(points, good, bad, soft: float = 0.1) -> float:
    """best_cut over counts of good and bad rows at ascending points, for any number of rows."""
    import numpy as np

    both = good + bad
    n, upto = both.sum(), np.cumsum(both)
    place = np.linspace(0, 1, 401) * (n - 1)
    below, above = (points[np.searchsorted(upto, at, side="right")] for at in (np.floor(place), np.ceil(place)))
    tries = below + (above - below) * (place - np.floor(place))
    tries = np.unique(np.concatenate([tries, (tries[1:] + tries[:-1]) / 2]))
    used = np.flatnonzero(both)
    points, good, bad = points[used], good[used] / good.sum(), bad[used] / bad.sum()
    both = both[used] / n
    width = soft * np.sqrt(both @ (points - both @ points) ** 2) + 1e-9
    step = lambda x: 1 / (1 + np.exp(np.clip(x / width, -30, 30)))
    right = [good @ step(t - points) + bad @ step(points - t) for t in tries]
    return float(tries[int(np.argmax(right))])
