"""Working through a backlog of documents that wait for a translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.changes import rows_of
from ..session import BROADCAST_BYTES, materialize, materialize_measured
from ..sources.store import IndexStore


def numbered(paths: DataFrame, key: str = "relpath") -> DataFrame:
    """Rows with their place (from 0) in the order of their paths, by range partitions: only the
    counts of the partitions come together."""
    spark = paths.sparkSession
    ranged = paths.repartitionByRange(key).sortWithinPartitions(key)
    placed = materialize(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "ordered"
    )
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy("_part").collect()
    before, rows = 0, []
    for part in parts:
        rows.append((part["_part"], before - part["first"]))
        before += part["n"]
    shift = spark.createDataFrame(rows, "_part int, _shift bigint")
    return placed.join(F.broadcast(shift), "_part").withColumn("place", F.col("_id") + F.col("_shift")).drop(
        "_part", "_id", "_shift"
    )


def drain_translations(
    store: IndexStore,
    corpus,
    translate: Callable[[DataFrame], DataFrame],
    batch: int = V.BATCH_DOCUMENTS,
    max_batches: int | None = None,
) -> int:
    """Translate the documents that wait, in the order of their paths, or the first
    ``max_batches`` batches of them, and index them in one update. ``translate`` takes (relpath,
    text) and gives (relpath, text), for example by ``mapInPandas``; batches are dealt over the
    tasks, each as a whole. Returns the number of batches. A document that gets no translation, or
    whose text is gone, still waits afterwards.
    """
    waiting = store.manifest().filter(F.col("status") == "pending_translation").select("relpath")
    placed = numbered(waiting).withColumn("batch", F.floor(F.col("place") / batch))
    if max_batches is not None:
        placed = placed.filter(F.col("batch") < max_batches)
    placed, _, size = materialize_measured(placed.select("relpath", "batch"), "batches")
    last = placed.agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    texts = rows_of(corpus, placed, size).select("relpath", "text").join(
        F.broadcast(placed) if size <= BROADCAST_BYTES else placed, "relpath"
    )
    tasks = min(last + 1, 4 * store.spark.sparkContext.defaultParallelism)
    dealt = texts.repartition(tasks, "batch").sortWithinPartitions("batch").select("relpath", "text")
    store.accept_translations(corpus, translate(dealt))
    return last + 1
