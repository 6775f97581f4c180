"""Document versions that arrive as files of rows, folded into an index batch by batch.

The manifest is the state: each micro-batch is reduced to the last version per path and
compared with it, so a batch that is delivered again changes nothing. A version without a
time is compared by its content.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import values as V
from ..operators.changes import pending_changes
from ..session import materialize
from ..sources.store import IndexStore
from ..sources.tables import latest_versions

LANDING = "relpath string, text string, mtime timestamp, size bigint, content_hash string"


def read_landing(spark: SparkSession, path: str, files_per_batch: int = V.BATCH_DOCUMENTS) -> DataFrame:
    """Stream of versioned document rows from parquet files that land in a folder."""
    return (
        spark.readStream.schema(LANDING)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def newer_versions(batch: DataFrame, store: IndexStore) -> DataFrame:
    """The last version per path, without those older than what the manifest records."""
    last = latest_versions(batch)
    # only the batch's own rows of the manifest take part in the join
    keys = batch.select("relpath").distinct()
    known = (
        store.manifest()
        .join(keys, "relpath", "left_semi")
        .select(F.col("relpath").alias("_known"), "original_mtime")
    )
    return (
        last.join(known, F.col("relpath") == F.col("_known"), "left")
        .filter(F.col("original_mtime").isNull() | F.col("mtime").isNull() | (F.col("mtime") >= F.col("original_mtime")))
        .select(*batch.columns)
    )


def _reduced(batch: DataFrame, store: IndexStore) -> DataFrame:
    """The versions of a batch, written once, as the steps of an update read them many times. They are
    dealt over all tasks: a batch often lands in fewer files, which Spark cannot split."""
    return materialize(newer_versions(batch, store).repartition(store.spark.sparkContext.defaultParallelism))


def _run_batches(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, str, int], None]) -> StreamingQuery:
    """Drain what has landed. ``run`` gets each batch with its stream's id, which outlives a restart
    from the same progress."""
    started, known = threading.Event(), {}

    def each(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        run(batch, known["id"], batch_id)

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    known["id"] = query.id
    started.set()
    return query


def stream_update(
    stream: DataFrame, store: IndexStore, checkpoint: str, translations: DataFrame | None = None
) -> StreamingQuery:
    """Drain what has landed: every batch runs an update of the store, which notes the batch in its
    commit, so that a batch that is repeated is passed over."""

    def run(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        source = f"{stream_id}/{batch_id}"
        if not store.took(source):
            store.update(_reduced(batch, store), translations, full_listing=False, source=source)

    return _run_batches(stream, checkpoint, run)


def stream_changes(stream: DataFrame, store: IndexStore, out: str, checkpoint: str) -> StreamingQuery:
    """Record the changes of every batch in ``out`` (one folder per stream and batch) and scan
    them into the manifest, without indexing. The store commits a batch after its record is
    complete; until then the batch is recorded anew, and afterwards never again."""

    def run(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        source = f"{stream_id}/{batch_id}"
        if store.took(source):
            return
        scanned = materialize(store.scan(_reduced(batch, store), full_listing=False), "scanned")
        found = pending_changes(scanned)
        found.write.mode("overwrite").parquet(f"{out}/stream={stream_id}/batch={batch_id}")
        store.record(scanned, source)

    return _run_batches(stream, checkpoint, run)
