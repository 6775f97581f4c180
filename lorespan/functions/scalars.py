"""Scalar columns: hashes, dates, language labels, previews, ids, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.trim(text, F.lit(V.WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(V.WHITESPACE))


def decode_text(content: Column) -> Column:
    """Bytes to text: malformed UTF-8 becomes U+FFFD, line ends become LF."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(content: Column) -> Column:
    """SHA-256 in hex of the raw bytes (of the UTF-8 bytes for a string)."""
    return F.sha2(content, 256)


def with_content_hash(df: DataFrame, content: str = "text", out: str = "content_hash") -> DataFrame:
    return df.withColumn(out, content_hash(F.col(content)))


def path_date(relpath: Column) -> Column:
    """YYYY-MM-DD found in the path, else eight digits in the file stem, else NULL.

    The calendar is not checked; the result stays text, as dates are compared as text.
    """
    dashed = F.regexp_extract(relpath, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    name = F.substring_index(relpath, "/", -1)
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")
    compact = F.regexp_extract(stem, r"[0-9]{8}", 0)
    rejoined = F.concat_ws(
        "-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2)
    )
    return F.when(dashed != "", dashed).when(compact != "", rejoined)


def with_date(df: DataFrame, path: str = "relpath", out: str = "date") -> DataFrame:
    return df.withColumn(out, path_date(F.col(path)))


def valid_date(date: Column) -> Column:
    """The text date as DATE, NULL where it is no calendar day."""
    return F.try_to_date(date, "yyyy-MM-dd")


# The same matches at linear cost: a run of non-blanks goes as a whole if it has a slash
# inside, so only its start needs a look. Java's Unicode white space lacks the four control
# separators, which become blanks before.
_PATH, _BLANKS = V.CLEANING_STEPS[4][0], V.CLEANING_STEPS[6][0]
_JAVA_FORM = {_PATH: r"(?U)(?<!\S)\S[^\s/]*+/\S++", _BLANKS: r"(?U)\s+"}


def clean_for_language(text: Column, prefix_chars: int | None = None) -> Column:
    """A text without code, links, markup, paths and prices; of its first characters only if
    asked for."""
    cleaned = text if prefix_chars is None else F.substring(text, 1, prefix_chars)
    for pattern, replacement in V.CLEANING_STEPS:
        if pattern == _PATH:
            cleaned = F.regexp_replace(cleaned, r"[\x1c-\x1f]", " ")
        cleaned = F.regexp_replace(cleaned, _JAVA_FORM.get(pattern, pattern), replacement)
    return strip(cleaned)


def marker_pattern(groups: list[str]) -> str:
    """One alternation for all marker groups: whole words, any case.

    Every match is exactly one word, so a single pass counts what the groups
    would count one after another.
    """
    return rf"(?iu)(?<![\pL\pN_])(?:{'|'.join(groups)})(?![\pL\pN_])"


def marker_hits(cleaned: Column, groups: list[str]) -> Column:
    return F.regexp_count(cleaned, F.lit(marker_pattern(groups)))


def language_label(
    cleaned: Column,
    markers: dict[str, list[str]] | None = None,
    source: str = V.SOURCE_LANGUAGE,
    target: str = V.TARGET_LANGUAGE,
    threshold: int = V.LANGUAGE_THRESHOLD,
) -> Column:
    """Source language when its markers are frequent enough, else target language."""
    groups = (V.MARKERS if markers is None else markers).get(source)
    if not groups:
        return F.lit(target)
    is_source = (F.length(cleaned) >= V.LANGUAGE_MIN_CHARS) & (
        marker_hits(cleaned, groups) >= threshold
    )
    return F.when(is_source, F.lit(source)).otherwise(F.lit(target))


def with_language(
    df: DataFrame,
    text: str = "text",
    markers: dict[str, list[str]] | None = None,
    source: str = V.SOURCE_LANGUAGE,
    target: str = V.TARGET_LANGUAGE,
    threshold: int = V.LANGUAGE_THRESHOLD,
    detector=None,
    prefix_chars: int | None = None,
) -> DataFrame:
    """Add ``language``. ``detector`` is an optional Column -> Column function (for
    example a pandas UDF) giving a language code; it is asked before the markers."""
    cleaned = F.col("_cleaned")
    label = language_label(cleaned, markers, source, target, threshold)
    if detector is not None:
        long_enough = F.length(cleaned) >= V.LANGUAGE_MIN_CHARS
        label = F.when(long_enough & (detector(cleaned) == source), F.lit(source)).otherwise(label)
    return (
        df.withColumn("_cleaned", clean_for_language(F.col(text), prefix_chars))
        .withColumn("language", label)
        .drop("_cleaned")
    )


def initial_status(
    language: Column, source: str = V.SOURCE_LANGUAGE, translation_enabled: bool = False
) -> Column:
    if not translation_enabled:
        return F.lit("pending_index")
    return F.when(language == source, "pending_translation").otherwise("pending_index")


def with_initial_status(
    df: DataFrame, source: str = V.SOURCE_LANGUAGE, translation_enabled: bool = False
) -> DataFrame:
    return df.withColumn("status", initial_status(F.col("language"), source, translation_enabled))


def strip_translation_header(text: Column) -> Column:
    """Drop one leading ``<!-- … -->``; a comment that is never closed stays.

    The text before the first ``-->`` is dropped, so ``<!-->`` closes at once.
    """
    body = lstrip(text)
    closed = body.startswith("<!--") & F.contains(body, F.lit("-->"))
    end = F.locate("-->", body)
    return F.when(closed, lstrip(F.substring(body, end + 3, F.length(body)))).otherwise(body)


def est_tokens(text: Column) -> Column:
    return tokens_of_chars(F.length(text))


def tokens_of_chars(chars: Column) -> Column:
    """Characters by four, rounded down."""
    return F.floor(chars / V.CHARS_PER_TOKEN).cast("int")


def chunk_prefix(source_file: Column, date: Column, section: Column) -> Column:
    dated = F.when(date != "", F.concat(F.lit("Date: "), date))
    return F.concat_ws(
        " | ", F.concat(F.lit("File: "), source_file), dated, F.concat(F.lit("Section: "), section)
    )


def chunk_id(relpath: Column, original_hash: Column, index: Column) -> Column:
    path_part = F.substring(F.md5(relpath), 1, 8)
    hash_part = F.substring(F.coalesce(original_hash, F.lit("unknown")), 1, 8)
    return F.concat_ws("_", path_part, hash_part, F.format_string("%03d", index))


def with_chunk_id(
    df: DataFrame, path: str = "relpath", original_hash: str = "original_hash", index: str = "chunk_index"
) -> DataFrame:
    return df.withColumn("id", chunk_id(F.col(path), F.col(original_hash), F.col(index)))


def stored_preview(content: Column, chars: int = V.STORED_PREVIEW) -> Column:
    return F.substring(content, 1, chars)


def shown_preview(preview: Column, chars: int = V.SHOWN_PREVIEW) -> Column:
    """One line for display: newlines to blanks, trimmed, cut with dots."""
    line = strip(F.replace(preview, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("..."))).otherwise(line)


def with_preview(
    df: DataFrame, content: str = "content", stored: int = V.STORED_PREVIEW, shown: int = V.SHOWN_PREVIEW
) -> DataFrame:
    return df.withColumn("content_preview", stored_preview(F.col(content), stored)).withColumn(
        "shown_preview", shown_preview(F.col("content_preview"), shown)
    )


def on_or_after(date: Column, after: str | Column) -> Column:
    """Text comparison; rows without a date pass an empty bound only. A bound that is given as
    text reaches the scan."""
    if isinstance(after, Column) or not after:
        return F.coalesce(date, F.lit("")) >= after
    return date >= F.lit(after)


def path_contains(source_file: Column, part: str | Column) -> Column:
    return F.contains(source_file, part if isinstance(part, Column) else F.lit(part))


def similarity_score(cosine: Column) -> Column:
    """Cosine in [-1, 1] to a score in [0, 1] with four places."""
    return F.round((F.lit(1.0) + cosine) / 2, 4)
