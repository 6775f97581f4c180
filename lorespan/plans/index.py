"""Indexing pending documents, and the jobs around it, as frames in and frames out.

``lorespan.sources.store`` holds the same jobs over persisted state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.changes import listing_of, manifest_rows, scan_corpus
from ..operators.chunks import chunk_columns, drop_chunks, sections_of
from ..operators.embed import Embedder, embed
from ..operators.routing import classify_indexability, found_texts, needs_translation, prune_translations
from ..operators.search import search
from ..operators.status import run_summary
from ..schemas import CHUNK_COLUMNS, MANIFEST_COLUMNS
from ..session import broadcast_if_small, materialize, materialize_measured


@dataclass(frozen=True)
class IndexOptions:
    max_tokens: int = V.MAX_TOKENS
    min_tokens: int = V.MIN_TOKENS
    translation_enabled: bool = False
    source: str = V.SOURCE_LANGUAGE
    target: str = V.TARGET_LANGUAGE
    threshold: int = V.LANGUAGE_THRESHOLD
    markers: dict | None = None
    detector: object = None
    mtime_tolerance: float = V.MTIME_TOLERANCE
    refresh_mtime: bool = True
    retry_errors: bool = False
    purge_on_error: bool = False
    buckets: int = 64


@dataclass(frozen=True)
class IndexResult:
    manifest: DataFrame
    chunks: DataFrame
    summary: DataFrame
    outcomes: DataFrame
    translations: DataFrame | None = None


def bucket_of(source_file: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source_file), F.lit(buckets)).cast("int")


def to_index(manifest: DataFrame, options: IndexOptions) -> DataFrame:
    statuses = ["pending_index", *(["error"] if options.retry_errors else [])]
    return manifest.filter(F.col("status").isin(statuses)).select(
        "relpath", "language", "date", "original_hash"
    )


def index_rows(
    todo: DataFrame,
    corpus,
    translations: DataFrame | None,
    embedder: Embedder | None,
    options: IndexOptions,
    size: int,
) -> DataFrame:
    """The one pass over texts: a row per chunk of each document that can be indexed, and a
    row without a chunk (``result`` says why) for each other document that has a text. ``size``
    bounds the bytes of ``todo``.

    Rows are rebalanced before the model runs. Tasks of even size embed even amounts of
    text, also when one file or bucket holds a large share of the chunks.
    """
    translated = needs_translation(F.col("language"), options.translation_enabled, options.source)
    routed = found_texts(todo.filter(~translated), corpus, size)
    if options.translation_enabled and translations is not None:
        routed = routed.unionByName(found_texts(todo.filter(translated), translations, size))
    sections = sections_of("body", options.max_tokens, options.min_tokens)
    exploded = (
        classify_indexability(routed)
        .drop("text")
        .select(
            "relpath", "language", "date", "original_hash", "result",
            F.posexplode_outer(sections).alias("chunk_index", "_section"),
        )
    )
    rows = exploded.select(
        "relpath",
        "result",
        *chunk_columns(F.col("relpath"), F.col("date"), F.col("language"), F.col("original_hash")),
    ).withColumn("bucket", bucket_of(F.col("relpath"), options.buckets))
    if embedder is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return embed(rows.hint("rebalance", "bucket"), "text", embedder)


def outcomes_of(rows: DataFrame, todo: DataFrame, options: IndexOptions) -> DataFrame:
    """relpath, result, chunk_count of everything in ``todo``: what its rows say, and where it has
    none, which text was not there. Counted per task first, whatever one file holds."""
    counted = rows.groupBy(F.col("relpath").alias("_path"), "result").agg(
        F.count("chunk_index").cast("int").alias("chunk_count")
    )
    translated = needs_translation(F.col("language"), options.translation_enabled, options.source)
    absent = F.when(translated, "no_translation").otherwise("file_not_found")
    return todo.join(counted, F.col("relpath") == F.col("_path"), "left").select(
        "relpath", F.coalesce("result", absent).alias("result"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )


def settle(
    rows: DataFrame, outcomes: DataFrame, indexed_at: Column, keep: list[str] | None = None
) -> DataFrame:
    """Manifest rows after their documents were handled, with the columns in ``keep``."""
    outcome = outcomes.select(
        F.col("relpath").alias("_done"), "result", F.col("chunk_count").alias("_count")
    )
    done = F.col("result")
    ok = done == "ok"
    failed = done.isNotNull() & ~done.isin("ok", "no_translation")
    new = {
        "status": F.when(ok, "indexed").when(failed, "error"),
        "indexed_at": F.when(ok, indexed_at),
        "chunk_count": F.when(ok, F.col("_count")),
        "error": F.when(failed, done),
    }
    joined = rows.join(outcome, F.col("relpath") == F.col("_done"), "left")
    return joined.select(
        *[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in MANIFEST_COLUMNS],
        *(keep or []),
    )


def _replaced_paths(outcomes: DataFrame, deleted: DataFrame, options: IndexOptions) -> DataFrame:
    """Files whose stored chunks go: indexed anew or deleted (and failed, if asked for)."""
    gone = F.col("result") == "ok"
    if options.purge_on_error:
        gone = F.col("result") != "no_translation"
    return outcomes.filter(gone).select("relpath").unionByName(deleted.select("relpath"))


def index_pending(
    manifest: DataFrame,
    corpus: DataFrame,
    chunks: DataFrame,
    translations: DataFrame | None = None,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    indexed_at: Column | None = None,
    everything: bool = False,
) -> IndexResult:
    """Index what is pending; drop chunks, rows and translations of deleted documents.

    The new rows are written once to the checkpoint folder; manifest, chunk table and
    counters all come from there, so texts are read and the model runs one time.
    """
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    if everything:
        todo = manifest.select("relpath", "language", "date", "original_hash").join(
            listing_of(corpus).select("relpath"), "relpath", "left_semi"
        )
        deleted = manifest.select("relpath").filter(F.lit(False))
    else:
        todo = to_index(manifest, options)
        deleted = manifest.filter(F.col("status") == "deleted").select("relpath")
    todo, _, size = materialize_measured(todo, "todo")
    rows = materialize(index_rows(todo, corpus, translations, embedder, options, size), "chunk-rows")
    outcomes = outcomes_of(rows, todo, options)
    fresh = rows.filter(F.col("result") == "ok").select(*CHUNK_COLUMNS)
    if everything:
        kept, current = None, manifest
    else:
        kept = drop_chunks(chunks, _replaced_paths(outcomes, deleted, options)).select(*CHUNK_COLUMNS)
        current = manifest.filter(F.coalesce(F.col("status"), F.lit("")) != "deleted")
    handled = outcomes.select("relpath", "result").unionByName(
        deleted.withColumn("result", F.lit("deleted"))
    )
    return IndexResult(
        manifest=settle(current, outcomes, stamp),
        chunks=fresh if kept is None else kept.unionByName(fresh),
        summary=run_summary(handled),
        outcomes=handled,
        translations=None if translations is None else prune_translations(translations, deleted),
    )


def rebuild(manifest: DataFrame, corpus: DataFrame, **arguments) -> IndexResult:
    """Index every manifest row whose original exists, whatever its status, into an empty
    chunk table."""
    return index_pending(manifest, corpus, chunks=None, everything=True, **arguments)


def update(
    corpus: DataFrame,
    manifest: DataFrame,
    chunks: DataFrame,
    translations: DataFrame | None = None,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    indexed_at: Column | None = None,
    full_listing: bool = True,
) -> IndexResult:
    """Scan, record the changes in the manifest, index what is pending."""
    scanned = materialize(
        manifest_rows(scan(corpus, manifest, options, full_listing), options.refresh_mtime)
    )
    if not full_listing:
        others = manifest.join(
            broadcast_if_small(scanned.select(F.col("relpath").alias("_seen"))),
            F.col("relpath") == F.col("_seen"),
            "left_anti",
        )
        scanned = scanned.unionByName(others.select(*MANIFEST_COLUMNS))
    return index_pending(scanned, corpus, chunks, translations, embedder, options, indexed_at)


def scan(
    corpus, manifest: DataFrame, options: IndexOptions = IndexOptions(), full_listing: bool = True
) -> DataFrame:
    """Every path with its action. ``corpus`` is a table or a ``FileCorpus``."""
    return scan_corpus(
        corpus,
        manifest,
        options.mtime_tolerance,
        options.source,
        options.translation_enabled,
        full_listing,
        markers=options.markers,
        target=options.target,
        threshold=options.threshold,
        detector=options.detector,
    )


def search_fresh(
    questions: DataFrame,
    manifest: DataFrame,
    corpus: DataFrame,
    chunks: DataFrame,
    translations: DataFrame | None = None,
    embedder: Embedder | None = None,
    options: IndexOptions = IndexOptions(),
    **search_options,
) -> DataFrame:
    """Search; index first if anything is pending."""
    if not manifest.filter(F.col("status") == "pending_index").isEmpty():
        chunks = index_pending(manifest, corpus, chunks, translations, embedder, options).chunks
    return search(chunks, questions, **search_options)
