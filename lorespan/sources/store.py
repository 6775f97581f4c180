"""Persisted index state: manifest and chunk table as parquet under one folder.

Every run writes one version. What a run writes is in proportion to what changed: the manifest
rows it settled, which also say whose older rows they replace, and new chunk rows. A row is live
if no later version replaces its key. The run's record in ``commits`` comes last; until it is
there readers do not see the version, and a run that failed is simply written anew.
``compact`` writes all live rows as a new base.

    commits/   v, base, source                 which versions to read; the batch a run took in
    run/v=N/   manifest row, kind              what run N had to handle: scanned or waiting
    settled/v=N/  manifest row, live, in_manifest, in_chunks
    chunks/v=N/result=R/bucket=B/              chunk rows (R=ok); documents without chunks
    translated/v=N/  relpath, text             translations that were accepted

One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.changes import beside_manifest, listing_of, look_at, manifest_rows, unclear
from ..operators.embed import Embedder
from ..operators.search import search
from ..plans.index import (
    IndexOptions,
    bucket_of,
    index_rows,
    outcomes_of,
    scan,
    settle,
    to_index,
)
from ..schemas import CHUNK_COLUMNS, CHUNKS, MANIFEST, MANIFEST_COLUMNS
from ..session import BROADCAST_BYTES, bytes_of, materialize_measured
from .files import qualified

_ROWS = CHUNKS + ", relpath string, v int, result string, bucket int"
_SETTLED = MANIFEST + ", live boolean, in_manifest boolean, in_chunks boolean, v int"
_COMMITS = "v int, base int, source string"
_RUN = MANIFEST + ", kind string"
_ROWS_PER_FILE = 1_000_000
#: Statuses of documents that a run takes up besides what its scan finds.
WAITING = ["pending_index", "deleted", "error"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One manifest snapshot; an absent one is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A whole snapshot under a path of its own, never the one it was read from."""
    manifest.select(*MANIFEST_COLUMNS).write.mode("errorifexists").parquet(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, rows_per_file: int = _ROWS_PER_FILE) -> None:
    """Append chunk rows, in directories by hash of their file. Rebalancing keeps a file or
    bucket with a large share of the rows from being written by one task."""
    placed = chunks.withColumn("bucket", bucket_of(F.col("source_file"), buckets))
    (
        placed.hint("rebalance", "bucket")
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("bucket")
        .parquet(path)
    )


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table; an absent one is empty."""
    schema = CHUNKS + ", bucket int"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def chunks_of_file(chunks: DataFrame, source_file: str, buckets: int = 64) -> DataFrame:
    """Chunks of one file: only its bucket is read."""
    return chunks.filter(
        (F.col("bucket") == bucket_of(F.lit(source_file), buckets)) & (F.col("source_file") == source_file)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@dataclass
class IndexStore:
    """An index under ``path``, with the jobs that read and advance it."""

    spark: SparkSession
    path: str
    options: IndexOptions = IndexOptions()
    embedder: Embedder | None = None
    _held: dict = field(default_factory=dict, repr=False)

    # --- versions ---------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        if not _exists(self.spark, where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    def current(self) -> tuple[int, int]:
        """Last committed version and the base it builds on."""
        rows = self._read("commits", _COMMITS).select("v", "base").collect()  # two numbers a run
        return max(((r["v"], r["base"]) for r in rows), default=(0, 0))

    def took(self, source: str) -> bool:
        """Whether a committed run has taken in this batch."""
        return not self._read("commits", _COMMITS).filter(F.col("source") == source).isEmpty()

    def _commit(self, version: int, base: int, source: str | None = None) -> None:
        record = self.spark.createDataFrame([(version, base, source)], _COMMITS)
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _write(self, df: DataFrame, name: str, version: int, partitions: list[str] | None = None) -> DataFrame:
        where = f"{self.path}/{name}/v={version}"
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", _ROWS_PER_FILE)
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _write_measured(self, df: DataFrame, name: str, version: int) -> tuple[DataFrame, int]:
        """A version of a narrow table, and the bytes of its rows, counted as they are written."""
        seen = Observation()
        written = self._write(df.observe(seen, bytes_of(df).alias("bytes")), name, version)
        return written, seen.get["bytes"]

    def _replaced(self, version: int, base: int) -> DataFrame:
        """The last version that replaces a key's manifest row and chunk rows, marked for
        broadcast as long as these are few; compaction keeps them so. Made once a version."""
        if (version, base) not in self._held:
            last = lambda flag: F.max(F.when(F.col(flag), F.col("v")))
            keys = (
                self._read("settled", _SETTLED)
                .filter(F.col("v").between(base + 1, version))
                .groupBy(F.col("relpath").alias("_key"))
                .agg(last("in_manifest").alias("_manifest_v"), last("in_chunks").alias("_chunks_v"))
            )
            keys, _, size = materialize_measured(keys, "replaced")
            self._held.clear()
            self._held[version, base] = F.broadcast(keys) if size <= BROADCAST_BYTES else keys
        return self._held[version, base]

    def _live(self, rows: DataFrame, key: str, flag: str, at: tuple[int, int] | None) -> DataFrame:
        """Rows that no later version replaces."""
        version, base = at or self.current()
        rows = rows.filter(F.col("v").between(base, version))
        if version == base:
            return rows
        later = (F.col(key) == F.col("_key")) & (F.col("v") < F.col(flag))
        return rows.join(self._replaced(version, base), later, "left_anti")

    def manifest(self, at: tuple[int, int] | None = None) -> DataFrame:
        rows = self._read("settled", _SETTLED).filter("live")
        return self._live(rows, "relpath", "_manifest_v", at).select(*MANIFEST_COLUMNS)

    def chunks(self) -> DataFrame:
        rows = self._read("chunks", _ROWS).filter(F.col("result") == "ok")
        return self._live(rows, "source_file", "_chunks_v", None).select(*CHUNK_COLUMNS, "bucket")

    def translations(self) -> DataFrame:
        """Accepted translations, the last of each document; those of a document go when a run
        finds it deleted."""
        version, _ = self.current()
        rows = self._read("translated", "relpath string, text string, v int").filter(F.col("v") <= version)
        last = rows.groupBy(F.col("relpath").alias("_path")).agg(F.max("v").alias("_v"))
        gone = (
            self._read("settled", _SETTLED)
            .filter(~F.col("live") & (F.col("v") <= version))
            .groupBy(F.col("relpath").alias("_gone"))
            .agg(F.max("v").alias("_gone_v"))
        )
        newest = rows.join(last, (F.col("relpath") == F.col("_path")) & (F.col("v") == F.col("_v")), "left_semi")
        return newest.join(
            gone, (F.col("relpath") == F.col("_gone")) & (F.col("v") <= F.col("_gone_v")), "left_anti"
        ).select("relpath", "text")

    # --- jobs -------------------------------------------------------------------

    def seed(self, manifest: DataFrame) -> int:
        """Take a manifest as it is for a new base without chunks."""
        version = self.current()[0] + 1
        self._write(_base_rows(manifest), "settled", version)
        self._commit(version, version)
        return version

    def scan(self, corpus, full_listing: bool = True) -> DataFrame:
        return scan(corpus, self.manifest(), self.options, full_listing)

    def update(
        self,
        corpus,
        translations: DataFrame | None = None,
        full_listing: bool = True,
        index: bool = True,
        indexed_at: Column | None = None,
        source: str | None = None,
    ) -> int:
        """Scan the corpus (a table or a ``FileCorpus``), index what is pending, commit. Returns
        the version. ``source`` names the batch in the commit (see ``took``).

        Each step writes its table and the next reads it, so an executor that is lost
        costs the step at hand only. Sizes come from these writes.
        """
        at = self.current()
        options = self.options
        beside = beside_manifest(listing_of(corpus), self.manifest(at), full_listing)
        look = unclear(options.mtime_tolerance)
        gone = F.col("relpath").isNull()
        found = beside.filter(look | gone).select(
            F.coalesce("relpath", "_known").alias("relpath"), "was", gone.alias("gone")
        )
        found, _, size = materialize_measured(found, "found")
        looked = look_at(
            corpus, found.filter("not gone").select("relpath", "was"), size,
            options.mtime_tolerance, options.source, options.translation_enabled,
            markers=options.markers, target=options.target, threshold=options.threshold, detector=options.detector,
        )
        scanned = manifest_rows(looked.filter((F.col("action") != "unchanged") | F.col("touched")), options.refresh_mtime)
        deleted = found.filter("gone").select("was.*").withColumn("status", F.lit("deleted"))
        return self._advance(at, scanned.unionByName(deleted), corpus, translations, index, indexed_at, source)

    def record(self, scanned: DataFrame, source: str | None = None) -> int:
        """Commit what a ``scan`` of the current version found to the manifest, without indexing."""
        found = scanned.filter((F.col("action") != "unchanged") | F.col("touched"))
        rows = manifest_rows(found, self.options.refresh_mtime)
        return self._advance(self.current(), rows, None, None, False, None, source)

    def index_only(
        self, corpus, translations: DataFrame | None = None, indexed_at: Column | None = None
    ) -> int:
        """Index what is pending without a scan."""
        return self._advance(self.current(), None, corpus, translations, True, indexed_at)

    def accept_translations(self, corpus, translations: DataFrame) -> int:
        """Turn rows whose translation has arrived to pending_index and index them."""
        at = self.current()
        arrived, size = self._write_measured(translations.select("relpath", "text"), "translated", at[0] + 1)
        keys = arrived.select("relpath")
        waiting = self.manifest(at).filter(F.col("status") == "pending_translation").join(
            F.broadcast(keys) if size <= BROADCAST_BYTES else keys, "relpath", "left_semi"
        )
        flipped = waiting.withColumn("status", F.lit("pending_index")).select(*MANIFEST_COLUMNS)
        return self._advance(at, flipped, corpus, arrived, True, None)

    def rebuild(
        self, corpus, translations: DataFrame | None = None, indexed_at: Column | None = None
    ) -> int:
        """Index all manifest rows that have an original into a new base."""
        at = self.current()
        version = at[0] + 1
        stamp = F.current_timestamp() if indexed_at is None else indexed_at
        manifest = self.manifest(at)
        present = listing_of(corpus).select(F.col("relpath").alias("_there"))
        held = manifest.join(present, F.col("relpath") == F.col("_there"), "left")
        kind = F.when(F.col("_there").isNotNull(), "waiting").otherwise("kept")
        rows, size = self._write_measured(held.select(*MANIFEST_COLUMNS, kind.alias("kind")), "run", version)
        todo = rows.filter("kind = 'waiting'").select("relpath", "language", "date", "original_hash")
        written = self._write_rows(todo, corpus, translations, version, size)
        settled = settle(rows, outcomes_of(written, todo, self.options), stamp)
        self._write(_base_rows(settled.select(*MANIFEST_COLUMNS)), "settled", version)
        self._commit(version, base=version)
        return version

    def compact(self) -> int:
        """Write the live rows as a new base."""
        at = self.current()
        version = at[0] + 1
        live = self.chunks().withColumn("relpath", F.col("source_file")).withColumn("result", F.lit("ok"))
        self._write(live.hint("rebalance", "bucket"), "chunks", version, ["result", "bucket"])
        self._write(_base_rows(self.manifest(at)), "settled", version)
        self._write(self.translations(), "translated", version)
        self._commit(version, base=version)
        return version

    def search(self, questions: DataFrame, **options) -> DataFrame:
        return search(self.chunks(), questions, **options)

    def search_fresh(
        self, questions: DataFrame, corpus: DataFrame, translations: DataFrame | None = None, **options
    ) -> DataFrame:
        """Search; index first if anything is pending."""
        if not to_index(self.manifest(), self.options).isEmpty():
            self.index_only(corpus, translations)
        return self.search(questions, **options)

    def last_outcomes(self) -> DataFrame:
        """relpath and result of every document that the last run handled."""
        version, _ = self.current()
        mine = F.col("v") == version
        handled = self._read("run", _RUN + ", v int").filter(mine)
        todo = to_index(handled, self.options)
        removed = handled.filter(F.col("status") == "deleted").select("relpath", F.lit("deleted").alias("result"))
        rows = self._read("chunks", _ROWS).filter(mine)
        return outcomes_of(rows, todo, self.options).select("relpath", "result").unionByName(removed)

    # --- steps ------------------------------------------------------------------

    def _write_rows(
        self, todo: DataFrame, corpus, translations: DataFrame | None, version: int, size: int
    ) -> DataFrame:
        rows = index_rows(todo, corpus, translations, self.embedder, self.options, size)
        if self.embedder is None:
            rows = rows.hint("rebalance", "bucket")
        return self._write(rows, "chunks", version, ["result", "bucket"])

    def _advance(
        self,
        at: tuple[int, int],
        scanned: DataFrame | None,
        corpus,
        translations: DataFrame | None,
        index: bool,
        indexed_at: Column | None,
        source: str | None = None,
    ) -> int:
        """From the manifest rows that a scan changed to a committed version."""
        version, base = at[0] + 1, at[1]
        stamp = F.current_timestamp() if indexed_at is None else indexed_at
        waiting = self.manifest(at).filter(F.col("status").isin(*WAITING))
        if scanned is None:
            run = waiting.withColumn("kind", F.lit("waiting"))
        elif not index:
            run = scanned.withColumn("kind", F.lit("scanned"))
        else:  # a row that the scan found goes before the one that waited
            every = scanned.withColumn("kind", F.lit("scanned")).unionByName(waiting.withColumn("kind", F.lit("waiting")))
            first = F.row_number().over(Window.partitionBy("relpath").orderBy("kind"))
            run = every.withColumn("_first", first).filter("_first = 1").drop("_first")
        run, size = self._write_measured(run.select(*MANIFEST_COLUMNS, "kind"), "run", version)
        if not index:
            self._write(_flagged(run, F.lit(True), F.lit(True), F.lit(False)), "settled", version)
            self._commit(version, base, source)
            return version
        todo = to_index(run, self.options)
        written = self._write_rows(todo, corpus, translations, version, size)
        done = settle(run, outcomes_of(written, todo, self.options), stamp, keep=["kind", "result"])
        deleted = F.col("status") == "deleted"
        handled = F.coalesce(F.col("result") != "no_translation", F.lit(False))
        cleared = handled if self.options.purge_on_error else F.coalesce(F.col("result") == "ok", F.lit(False))
        seen = (F.col("kind") == "scanned") | handled | deleted
        rows = _flagged(done.filter(seen), ~deleted, F.lit(True), cleared | deleted)
        self._write(rows, "settled", version)
        self._commit(version, base, source)
        return version


def _flagged(rows: DataFrame, live: Column, in_manifest: Column, in_chunks: Column) -> DataFrame:
    flags = {"live": live, "in_manifest": in_manifest, "in_chunks": in_chunks}
    return rows.select(*MANIFEST_COLUMNS, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def _base_rows(manifest: DataFrame) -> DataFrame:
    """Rows of a new base: they replace nothing, as nothing older is read."""
    return _flagged(manifest, F.lit(True), F.lit(False), F.lit(False))
