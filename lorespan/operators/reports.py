"""JSON documents of search hits, status, listings and pending changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_FIELDS = [
    "id", "score", "source_file", "section", "date", "language", "content_preview", "full_text",
]
CHANGE_FIELDS = ["relpath", "action", "language", "date", "status", "hash", "mtime", "size"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def hits_to_json(
    hits: DataFrame, questions: DataFrame, total_chunks: Column | int, pending_translation: Column | int
) -> DataFrame:
    """query_id and ``json``: one envelope per question (at most k hits each), also for
    questions without hits."""

    def column(value: Column | int) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    ranked = F.collect_list(F.struct("rank", F.struct(*HIT_FIELDS).alias("hit")))
    results = hits.groupBy("query_id").agg(
        F.transform(F.array_sort(ranked), lambda r: r["hit"]).alias("results")
    )
    envelope = F.struct(
        F.col("question").alias("query"),
        F.coalesce("results", F.array().cast(results.schema["results"].dataType)).alias("results"),
        column(total_chunks).alias("total_chunks"),
        column(pending_translation).alias("pending_translation"),
    )
    return (
        questions.select("query_id", "question")
        .join(results, "query_id", "left")
        .select("query_id", F.to_json(envelope, KEEP_NULLS).alias("json"))
    )


def rows_to_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, for status and counter frames."""
    return df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS).alias("json"))


def sources_to_json(listed: DataFrame) -> DataFrame:
    """A listing cut by ``limit_with_flag`` as one document (its length is the limit)."""
    fields = ["path", "status", "language", "date", "chunk_count"]
    files = F.array_sort(F.collect_list(F.struct(*fields)))
    return listed.agg(
        F.to_json(
            F.struct(
                files.alias("files"),
                F.count(F.lit(1)).alias("total_matched"),
                F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
            )
        ).alias("json")
    )


def pending_report(changes: DataFrame) -> DataFrame:
    """One JSON line per change. A change set has no bound, so it is a table of lines to be
    written with ``write.text``, beside the counters of ``scan_stats``."""
    deleted = F.to_json(F.struct("relpath", "action"))
    pending = F.to_json(
        F.struct(
            "relpath", "action", "language", "date", "status", "hash",
            F.unix_micros("mtime").alias("mtime_micros"), "size",
        ),
        KEEP_NULLS,
    )
    return changes.select(
        "relpath", F.when(F.col("action") == "deleted", deleted).otherwise(pending).alias("json")
    )
