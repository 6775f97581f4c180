"""Corpora that are tables: one row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import BROADCAST_BYTES, materialize_measured


def corpus_from_table(
    df: DataFrame, key: str = "relpath", text: str = "text", mtime: str = "mtime"
) -> DataFrame:
    """Any document table as a corpus. Size and hash are computed where the row is read."""
    return df.select(
        F.col(key).alias("relpath"),
        F.col(text).alias("text"),
        F.col(mtime).alias("mtime"),
        F.octet_length(F.col(text)).cast("bigint").alias("size"),
        S.content_hash(F.col(text)).alias("content_hash"),
    )


def latest_versions(df: DataFrame, key: str = "relpath") -> DataFrame:
    """One row per path, the last by mtime (then by hash). The last version is found on narrow
    rows, combined before they are shuffled; texts are fetched for these versions alone and take
    part in no aggregation, but for versions that were delivered more than once."""
    version = F.struct("mtime", "content_hash")
    counted = df.groupBy(key, version.alias("_version")).agg(F.count(F.lit(1)).alias("_n"))
    last = counted.groupBy(key).agg(F.max(F.struct("_version", "_n")).alias("_last")).select(
        F.col(key).alias("_key"), "_last._version", "_last._n"
    )
    last, _, size = materialize_measured(last, "last-versions")
    last = F.broadcast(last) if size <= BROADCAST_BYTES else last
    same = F.col(key).eqNullSafe(F.col("_key")) & version.eqNullSafe(F.col("_version"))
    found = df.join(last, same)
    found = found.select(*df.columns, "_n")
    again = found.filter("_n > 1").dropDuplicates([key])
    return found.filter("_n = 1").unionByName(again).select(*df.columns)
