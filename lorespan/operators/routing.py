"""Which text of a document is indexed, and whether it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import BROADCAST_BYTES, broadcast_if_small, fits_broadcast
from .changes import delete_keys, only_listed

_FOUND = "_found"


def attach_text(rows: DataFrame, texts) -> DataFrame:
    """Narrow rows (relpath, …) with ``text``, NULL where there is none, and ``_found``.

    When the rows are few they are broadcast and the texts stay where they are read;
    only when they are many does the text move to them. Of a file tree only their files are read.
    """
    if not isinstance(texts, DataFrame):
        found = texts.rows_of(rows).select("relpath", "text", F.lit(True).alias(_FOUND))
        return rows.join(found, "relpath", "left").withColumn(_FOUND, F.coalesce(_FOUND, F.lit(False)))
    found = texts.select("relpath", "text", F.lit(True).alias(_FOUND))
    if not fits_broadcast(rows):
        return rows.join(found, "relpath", "left").withColumn(_FOUND, F.coalesce(_FOUND, F.lit(False)))
    hit = found.join(F.broadcast(rows), "relpath").select(*rows.columns, "text", _FOUND)
    # at most as many keys as there are rows
    known = texts.select("relpath").join(F.broadcast(rows.select("relpath")), "relpath", "left_semi")
    missing = rows.join(F.broadcast(known.distinct()), "relpath", "left_anti")
    return hit.unionByName(
        missing.select(*rows.columns, F.lit(None).cast("string").alias("text"), F.lit(False).alias(_FOUND))
    )


def found_texts(rows: DataFrame, texts, size: int) -> DataFrame:
    """Rows (of ``size`` bytes at most) with ``text``, only those that have one."""
    if not isinstance(texts, DataFrame):
        return rows.join(texts.rows_of(rows).select("relpath", "text"), "relpath")
    found = texts.select("relpath", "text")
    if size <= BROADCAST_BYTES:
        return found.join(F.broadcast(rows), "relpath").select(*rows.columns, "text")
    return only_listed(found, rows, size=size).join(rows, "relpath").select(*rows.columns, "text")


def needs_translation(language: Column, enabled: bool, source: str) -> Column:
    return F.coalesce(language == source, F.lit(False)) if enabled else F.lit(False)


def route_text(
    docs: DataFrame, translations: DataFrame, enabled: bool, source: str = V.SOURCE_LANGUAGE
) -> DataFrame:
    """Documents with the text to index in ``text`` (NULL where a translation is missing) and
    ``route``: original, translation, no_translation. Originals never move."""
    translated = needs_translation(F.col("language"), enabled, source)
    originals = docs.filter(~translated).withColumn("route", F.lit("original"))
    routed = attach_text(docs.filter(translated).drop("text"), translations)
    routed = routed.withColumn(
        "route", F.when(F.col(_FOUND), "translation").otherwise("no_translation")
    ).drop(_FOUND)
    return originals.unionByName(routed)


def classify_indexability(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``result`` ok, empty_file, no_chunks or the reason in ``missing``, and ``body``:
    the text to chunk, NULL unless ok."""
    missing = F.col("missing") if "missing" in df.columns else F.lit(None).cast("string")
    blank = F.coalesce(S.strip(F.col(text)), F.lit("")) == ""
    body = S.strip_translation_header(F.col(text))
    result = (
        F.when(missing.isNotNull(), missing)
        .when(blank, "empty_file")
        .when(S.strip(F.col("body")) == "", "no_chunks")
        .otherwise("ok")
    )
    return (
        df.withColumn("body", F.when(~blank, body))
        .withColumn("result", result)
        .withColumn("body", F.when(F.col("result") == "ok", F.col("body")))
    )


def prune_translations(translations: DataFrame, removed: DataFrame) -> DataFrame:
    """Translations without those of removed documents."""
    return delete_keys(translations, removed)


def outgoing_translations(manifest: DataFrame) -> DataFrame:
    """Rows that wait for a translation."""
    return manifest.filter(F.col("status") == "pending_translation")


def accept_translations(manifest: DataFrame, translations: DataFrame) -> DataFrame:
    """The manifest after translated rows came back: these become pending_index."""
    waiting = manifest.filter(F.col("status") == "pending_translation").select("relpath")
    arrived = broadcast_if_small(
        translations.select("relpath")
        .join(waiting, "relpath", "left_semi")
        .select(F.col("relpath").alias("_arrived"))
        .distinct()
    )
    flips = F.col("_arrived").isNotNull() & (F.col("status") == "pending_translation")
    joined = manifest.join(arrived, F.col("relpath") == F.col("_arrived"), "left")
    return joined.withColumn(
        "status", F.when(flips, "pending_index").otherwise(F.col("status"))
    ).drop("_arrived")
