"""Notes rendered into corpus documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# --- fixed values: note format ------------------------------------------------
NOTE_DIR = "knowledge/diary"
DEFAULT_TITLE = "session-summary"
DEFAULT_SESSION = "ad-hoc"
DEFAULT_AGENT = "human"
STAMP_FORMAT = "yyyy-MM-dd_HHmmss"


def _or_default(name: str, default: str):
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def render_notes(notes: DataFrame) -> DataFrame:
    """Notes (content, title, session, agent, tags, written_at) as documents of a corpus.

    A name is made of a stamp in seconds and the title: notes that share both share
    a path, and the last one wins when the corpus is read.
    """
    utc = F.to_utc_timestamp("written_at", F.current_timezone())
    stamp = F.date_format(utc, STAMP_FORMAT)
    title = _or_default("title", DEFAULT_TITLE)
    text = F.concat(
        F.lit("# Diary: "), title,
        F.lit("\n\n- Date: "), stamp,
        F.lit(" UTC\n- Session: "), _or_default("session", DEFAULT_SESSION),
        F.lit("\n- Agent: "), _or_default("agent", DEFAULT_AGENT),
        F.lit("\n- Tags: "), _or_default("tags", ""),
        F.lit("\n\n---\n\n"), F.col("content"),
    )
    relpath = F.concat(F.lit(NOTE_DIR + "/"), stamp, F.lit("_"), F.translate(title, " /", "__"), F.lit(".md"))
    rendered = notes.select(relpath.alias("relpath"), text.alias("text"), F.col("written_at").alias("mtime"))
    return rendered.select(
        "relpath",
        "text",
        "mtime",
        F.octet_length("text").cast("bigint").alias("size"),
        S.content_hash(F.col("text")).alias("content_hash"),
    )
