"""Documents to chunk rows, and operations on chunk tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import scalars as S
from ..functions import values as V
from ..session import broadcast_if_small


def chunk_columns(relpath: Column, date: Column, language: Column, original_hash: Column) -> list[Column]:
    """Columns of a chunk row beside an exploded ``section`` and its ``chunk_index``."""
    header, content = F.col("_section.header"), F.col("_section.content")
    full_text = F.concat(S.chunk_prefix(relpath, date, header), F.lit("\n\n"), content)
    return [
        S.chunk_id(relpath, original_hash, F.col("chunk_index")).alias("id"),
        relpath.alias("source_file"),
        header.alias("section"),
        F.coalesce(date, F.lit("")).alias("date"),
        F.coalesce(language, F.lit(V.TARGET_LANGUAGE)).alias("language"),
        F.col("chunk_index"),
        content.alias("content"),
        full_text.alias("text"),
        S.stored_preview(content).alias("content_preview"),
    ]


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


@lru_cache(maxsize=32)
def _sections_of(application: str, text: str, max_tokens: int, min_tokens: int) -> Column:
    return C.chunk_sections(F.col(text), max_tokens, min_tokens)


def sections_of(text: str, max_tokens: int, min_tokens: int) -> Column:
    """The section array of a text column. The expression is long, so it is built once per
    application and used again."""
    application = SparkContext._active_spark_context.applicationId
    return _sections_of(application, text, max_tokens, min_tokens)


def chunk_corpus(
    docs: DataFrame, max_tokens: int = V.MAX_TOKENS, min_tokens: int = V.MIN_TOKENS
) -> DataFrame:
    """Documents (relpath, text; date, language and original_hash if known) to chunk rows.

    No shuffle: a chunk's index is its place in the document's section array.
    """
    exploded = docs.select(
        "relpath",
        _optional(docs, "date").alias("date"),
        _optional(docs, "language").alias("language"),
        _optional(docs, "original_hash").alias("original_hash"),
        F.posexplode(sections_of("text", max_tokens, min_tokens)).alias(
            "chunk_index", "_section"
        ),
    )
    return exploded.select(
        *chunk_columns(F.col("relpath"), F.col("date"), F.col("language"), F.col("original_hash"))
    )


def with_chunk_key(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_key``, which is unique. The short hashes of ``id`` are not, when a table
    holds very many copies of one text."""
    number = F.lpad(F.col("chunk_index").cast("string"), 9, "0")
    return chunks.withColumn("chunk_key", F.concat_ws("#", "source_file", number))


def inspect_chunks(chunks: DataFrame) -> DataFrame:
    """Per chunk: section, token estimate of its full text, preview on one line."""
    preview = F.replace(F.substring("content", 1, V.SHOWN_PREVIEW), F.lit("\n"), F.lit(" "))
    return chunks.select(
        "source_file",
        "chunk_index",
        "section",
        S.est_tokens(F.col("text")).alias("tokens"),
        F.concat(preview, F.lit("...")).alias("preview"),
    )


def chunk_sizes(chunks: DataFrame, step: int = 100) -> DataFrame:
    """How many chunks have how many tokens, in steps."""
    low = (F.floor(S.est_tokens(F.col("text")) / step) * step).cast("int")
    return chunks.groupBy(low.alias("tokens_from")).agg(F.count(F.lit(1)).alias("chunks"))


def chunks_of(chunks: DataFrame, paths: DataFrame, path: str = "relpath") -> DataFrame:
    """All chunks of the listed files."""
    keys = broadcast_if_small(paths.select(F.col(path).alias("_key")))
    return chunks.join(keys, F.col("source_file") == F.col("_key"), "left_semi")


def drop_chunks(chunks: DataFrame, paths: DataFrame, path: str = "relpath") -> DataFrame:
    """Chunks without those of the listed files. A long list is joined by a shuffle, in
    which adaptive execution may split a file that has very many chunks."""
    keys = broadcast_if_small(paths.select(F.col(path).alias("_key")))
    return chunks.join(keys, F.col("source_file") == F.col("_key"), "left_anti")
