"""Counters and listings over manifest and chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def index_status(
    manifest: DataFrame,
    chunks: DataFrame | None,
    source: str = V.SOURCE_LANGUAGE,
    target: str = V.TARGET_LANGUAGE,
) -> DataFrame:
    """One row: documents by status, files in source and target language, chunks by the
    manifest and by the store (-1 without a store)."""
    status, language = F.col("status"), F.col("language")
    stored = (
        F.lit(-1).cast("bigint")
        if chunks is None
        else chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    counters = manifest.agg(
        F.count(F.lit(1)).alias("manifest_entries"),
        _count(status == "indexed", "indexed"),
        _count(status == "pending_translation", "pending_translation"),
        _count(status == "pending_index", "pending_index"),
        _count(status == "error", "errors"),
        _count(language == source, "source_files"),
        _count(language == target, "target_files"),
        F.coalesce(F.sum(F.coalesce("chunk_count", F.lit(0))), F.lit(0)).alias("manifest_chunks"),
    )
    return counters.withColumn("stored_chunks", stored)


def language_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def status_count(manifest: DataFrame, status: str) -> DataFrame:
    return manifest.agg(_count(F.col("status") == status, "files"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of one run from one row per handled document with its ``result``."""
    result = F.col("result")
    return outcomes.agg(
        _count(result == "ok", "indexed"),
        _count(result == "no_translation", "skipped"),
        _count(~result.isin("ok", "no_translation", "deleted"), "errors"),
        _count(result == "deleted", "deleted"),
    )


def index_drift(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files for which the manifest's chunk count is not what the store holds."""
    expected = manifest.select("relpath", F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("expected"))
    stored = chunks.groupBy(F.col("source_file").alias("relpath")).agg(F.count(F.lit(1)).alias("stored"))
    both = expected.join(stored, "relpath", "full_outer").select(
        "relpath",
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("stored", F.lit(0)).alias("stored"),
    )
    return both.filter(F.col("expected") != F.col("stored"))


def sort_by_path(df: DataFrame, path: str = "relpath") -> DataFrame:
    return df.orderBy(path)


def next_batch(manifest: DataFrame, n: int = V.BATCH_DOCUMENTS, status: str = "pending_translation") -> DataFrame:
    """The first n documents that wait, by path."""
    return manifest.filter(F.col("status") == status).orderBy("relpath").limit(n)


def list_sources(
    manifest: DataFrame, path: str | None = None, status: str | None = None, limit: int | None = None
) -> DataFrame:
    """Files by path, with defaults for missing fields."""
    rows = manifest
    if path:
        rows = rows.filter(F.contains(F.col("relpath"), F.lit(path)))
    if status:
        rows = rows.filter(F.col("status") == status)
    listed = rows.select(
        F.col("relpath").alias("path"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("date", F.lit("")).alias("date"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    ).orderBy("path")
    return listed if limit is None else listed.limit(limit)


def limit_with_flag(df: DataFrame, n: int, order: str = "path") -> DataFrame:
    """The first n rows with ``total_matched`` (never more than n) and ``truncated`` (true
    as soon as n rows matched)."""
    first = df.orderBy(order).limit(n)
    total = first.agg(F.count(F.lit(1)).alias("n")).scalar()
    return first.withColumn("total_matched", total).withColumn("truncated", F.col("total_matched") >= n)
