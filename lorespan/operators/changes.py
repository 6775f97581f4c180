"""Change detection, and the set operations on keyed tables.

A scan looks at times before it looks at texts: a narrow listing is joined with the manifest, and
only documents that are new or have another time are read, hashed and labelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..schemas import MANIFEST_COLUMNS
from ..session import BROADCAST_BYTES, broadcast_if_small, materialize, materialize_measured

#: Bits of the filter that stands before a shuffled fetch: 2 MB of them, whatever it holds.
FILTER_BITS = 1 << 24

CHANGE_COLUMNS = ["relpath", "action", "language", "date", "status", "hash", "mtime", "size"]


def label_corpus(
    corpus: DataFrame,
    markers: dict[str, list[str]] | None = None,
    source: str = V.SOURCE_LANGUAGE,
    target: str = V.TARGET_LANGUAGE,
    threshold: int = V.LANGUAGE_THRESHOLD,
    detector=None,
) -> DataFrame:
    """Narrow rows of a corpus: hash, language and date are made where the text is read,
    so that no text takes part in the shuffle that follows."""
    labelled = S.with_date(
        S.with_language(corpus, "text", markers, source, target, threshold, detector)
    )
    hashed = F.col("content_hash") if "content_hash" in corpus.columns else S.content_hash(F.col("text"))
    return labelled.select("relpath", hashed.alias("hash"), "mtime", "size", "language", "date")


def _same_mtime(a: Column, b: Column, tolerance: float) -> Column:
    apart = F.abs(F.unix_micros(a) - F.unix_micros(b))
    return F.coalesce(apart < F.lit(tolerance * 1_000_000), F.lit(False))


def classify(
    labelled: DataFrame,
    manifest: DataFrame,
    mtime_tolerance: float = V.MTIME_TOLERANCE,
    source: str = V.SOURCE_LANGUAGE,
    translation_enabled: bool = True,
    full_listing: bool = True,
) -> DataFrame:
    """Every path of listing and manifest with its action: new, changed, unchanged, deleted.

    ``touched`` marks unchanged content under a new mtime, ``was`` is the manifest row.
    With ``full_listing`` off the listing is a delta: paths it lacks are not deleted.
    """
    return _with_actions(
        beside_manifest(labelled, manifest, full_listing), mtime_tolerance, source, translation_enabled
    )


def beside_manifest(listing: DataFrame, manifest: DataFrame, full_listing: bool) -> DataFrame:
    """Rows of a listing with their manifest row (``_known``, ``was``), and, for a full listing,
    manifest rows without one."""
    known = manifest.select(
        F.col("relpath").alias("_known"), F.struct(*MANIFEST_COLUMNS).alias("was")
    )
    if full_listing:
        return listing.join(known, F.col("relpath") == F.col("_known"), "full_outer")
    keys = listing.select(F.col("relpath").alias("_key"))
    hit = known.join(keys, F.col("_known") == F.col("_key"), "left_semi")
    return listing.join(hit, F.col("relpath") == F.col("_known"), "left")


def _with_actions(
    joined: DataFrame, mtime_tolerance: float, source: str, translation_enabled: bool
) -> DataFrame:
    present, recorded = F.col("relpath").isNotNull(), F.col("_known").isNotNull()
    same_mtime = _same_mtime(F.col("mtime"), F.col("was.original_mtime"), mtime_tolerance)
    same_hash = F.coalesce(F.col("hash") == F.col("was.original_hash"), F.lit(False))
    action = (
        F.when(~present, "deleted")
        .when(~recorded, "new")
        .when(same_mtime | same_hash, "unchanged")
        .otherwise("changed")
    )
    return (
        joined.withColumn("action", action)
        .withColumn("touched", present & recorded & ~same_mtime & same_hash)
        .withColumn(
            "status",
            F.when(
                F.col("action").isin("new", "changed"),
                S.initial_status(F.col("language"), source, translation_enabled),
            ),
        )
        .withColumn("relpath", F.coalesce("relpath", "_known"))
        .drop("_known")
    )


def listing_of(corpus) -> DataFrame:
    """Path and time of a corpus: a table, or anything with a ``listing`` (a file tree). No text
    is read for it."""
    listing = corpus if isinstance(corpus, DataFrame) else corpus.listing
    return listing.select("relpath", "mtime")


def rows_of(corpus, keys: DataFrame, size: int | None = None) -> DataFrame:
    """The rows of a corpus whose paths are in ``keys`` (of ``size`` bytes, if that is known)."""
    if not isinstance(corpus, DataFrame):
        return corpus.rows_of(keys)
    return only_listed(corpus, keys, size=size)


def only_listed(
    rows: DataFrame, keys: DataFrame, key: str = "relpath", size: int | None = None, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows whose key is listed. A short list is sent to the rows. A long one is joined by a
    shuffle, and a filter of FILTER_BITS hashed keys is sent ahead, so that few other rows move."""
    listed = keys.select(F.col(key).alias("_listed"))
    small = broadcast_if_small(listed, limit) if size is None else F.broadcast(listed) if size <= limit else listed
    on = F.col(key) == F.col("_listed")
    if small is not listed:
        return rows.join(small, on, "left_semi")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (place(c) % 64).cast("int"))
    bits = listed.groupBy(F.floor(place("_listed") / 64).alias("_word")).agg(F.bit_or(bit("_listed")).alias("_bits"))
    may = F.col("_bits").bitwiseAND(bit(key)) != 0
    ahead = rows.join(F.broadcast(bits), (F.floor(place(key) / 64) == F.col("_word")) & may, "left_semi")
    return ahead.join(listed, on, "left_semi")


def _hashed_first(corpus, candidates: DataFrame, was: DataFrame, source: str, labels: dict) -> DataFrame:
    """Narrow rows of the candidates in a file tree. Only files whose hash is another are read as
    text; the others keep what the manifest knows of them."""
    hashed = materialize(corpus.hashes_of(candidates), "hashes")
    beside = hashed.join(was, F.col("relpath") == F.col("_path"), "left")
    same = F.coalesce(F.col("content_hash") == F.col("was.original_hash"), F.lit(False))
    kept = beside.filter(same).select(
        "relpath", F.col("content_hash").alias("hash"), "mtime", "size",
        F.col("was.language").alias("language"), F.col("was.date").alias("date"),
    )
    other = materialize(beside.filter(~same).select("relpath"), "changed-files")
    return label_corpus(corpus.rows_of(other), source=source, **labels).unionByName(kept)


def unclear(mtime_tolerance: float = V.MTIME_TOLERANCE) -> Column:
    """Listed beside the manifest, but new or with another time: the content has to be looked at."""
    same = _same_mtime(F.col("mtime"), F.col("was.original_mtime"), mtime_tolerance)
    return F.col("relpath").isNotNull() & ~same


def look_at(
    corpus, candidates: DataFrame, size: int, mtime_tolerance: float, source: str, translation_enabled: bool, **labels
) -> DataFrame:
    """The action of each candidate (relpath, was; of ``size`` bytes) from its hash; no other row
    of the corpus is read."""
    was = candidates.select(F.col("relpath").alias("_path"), F.col("was.relpath").alias("_known"), "was")
    was = F.broadcast(was) if size <= BROADCAST_BYTES else was
    if isinstance(corpus, DataFrame):
        read = label_corpus(rows_of(corpus, candidates, size), source=source, **labels)
    else:
        read = _hashed_first(corpus, candidates, was, source, labels)
    beside = read.join(was, F.col("relpath") == F.col("_path")).drop("_path")
    return _with_actions(beside.filter(unclear(mtime_tolerance)), mtime_tolerance, source, translation_enabled)


def scan_corpus(
    corpus,
    manifest: DataFrame,
    mtime_tolerance: float = V.MTIME_TOLERANCE,
    source: str = V.SOURCE_LANGUAGE,
    translation_enabled: bool = True,
    full_listing: bool = True,
    **labels,
) -> DataFrame:
    """``classify`` for a corpus whose texts are read only where the time says nothing. Unchanged
    paths show the hash, language, date and size that the manifest has."""
    beside = beside_manifest(listing_of(corpus), manifest, full_listing)
    look = unclear(mtime_tolerance)
    candidates, _, size = materialize_measured(
        beside.filter(look).select("relpath", "was").dropDuplicates(["relpath"]), "candidates"
    )
    looked = look_at(corpus, candidates, size, mtime_tolerance, source, translation_enabled, **labels)
    present = F.col("relpath").isNotNull()
    sure = beside.filter(~look).select(
        F.coalesce("relpath", "_known").alias("relpath"),
        *[F.when(present, F.col(f"was.{of}")).alias(c) for c, of in (
            ("hash", "original_hash"), ("size", "size"), ("language", "language"), ("date", "date"))],
        "mtime",
        "was",
        F.when(present, "unchanged").otherwise("deleted").alias("action"),
        F.lit(False).alias("touched"),
        F.lit(None).cast("string").alias("status"),
    )
    return looked.unionByName(sure)


def pending_changes(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("action").isin("new", "changed")).select(*CHANGE_COLUMNS)


def deleted_changes(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("action") == "deleted").select("relpath", "action")


def change_set(pending: DataFrame, deleted: DataFrame) -> DataFrame:
    return pending.unionByName(deleted, allowMissingColumns=True)


def detect_changes(corpus, manifest: DataFrame, **options) -> DataFrame:
    """Pending and deleted paths of a corpus against a manifest."""
    changed = scan_corpus(corpus, manifest, **options).filter(F.col("action") != "unchanged")
    gone = F.col("action") == "deleted"
    return changed.select(
        "relpath",
        "action",
        *[F.when(~gone, F.col(c)).alias(c) for c in CHANGE_COLUMNS[2:]],
    )


def new_paths(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    return corpus.select("relpath").join(manifest.select("relpath"), "relpath", "left_anti")


def deleted_paths(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.select("relpath").join(corpus.select("relpath"), "relpath", "left_anti")


def file_candidates(
    listing: DataFrame, manifest: DataFrame, mtime_tolerance: float = V.MTIME_TOLERANCE
) -> DataFrame:
    """Files whose content has to be looked at: no manifest row, or another mtime."""
    known = manifest.select("relpath", "original_mtime")
    return (
        listing.select("relpath", "path", "mtime", "size")
        .join(known, "relpath", "left")
        .filter(~_same_mtime(F.col("mtime"), F.col("original_mtime"), mtime_tolerance))
        .drop("original_mtime")
    )


def scan_stats(classified: DataFrame) -> DataFrame:
    """Scan counters in one pass over the classified paths."""

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    action, status = F.col("action"), F.col("status")
    return classified.agg(
        count(action != "deleted", "total_files"),
        count(action == "unchanged", "unchanged"),
        count(action == "new", "new"),
        count(action == "changed", "changed"),
        count(action == "deleted", "deleted"),
        count(status == "pending_translation", "pending_translation"),
        count(status == "pending_index", "pending_index"),
        count(F.col("was").isNotNull(), "manifest_entries"),
        count(F.col("was.status") == "indexed", "indexed"),
    )


def manifest_rows(classified: DataFrame, refresh_mtime: bool = True) -> DataFrame:
    """The manifest after a scan, from the same join that found the changes.

    New and changed paths get a whole new row, deleted ones keep theirs under the
    status ``deleted``, touched ones may take over the new mtime.
    """
    fresh = F.col("action").isin("new", "changed")
    replaced = {
        "original_hash": F.col("hash"),
        "original_mtime": F.col("mtime"),
        "language": F.col("language"),
        "date": F.col("date"),
        "status": F.col("status"),
        "size": F.col("size"),
        "source_mtime": F.col("mtime"),
    }
    kept = {c: F.col(f"was.{c}") for c in MANIFEST_COLUMNS}
    kept["status"] = F.when(F.col("action") == "deleted", F.lit("deleted")).otherwise(kept["status"])
    if refresh_mtime:
        kept["original_mtime"] = F.when(F.col("touched"), F.col("mtime")).otherwise(kept["original_mtime"])
    columns = [F.col("relpath")]
    for c in MANIFEST_COLUMNS[1:]:
        columns.append(F.when(fresh, replaced[c]).otherwise(kept[c]).alias(c) if c in replaced
                       else F.when(~fresh, kept[c]).alias(c))
    return classified.select(*columns)


def upsert(target: DataFrame, source: DataFrame, key: str = "relpath", mode: str = "replace") -> DataFrame:
    """Rows of ``source`` into ``target``: ``replace`` takes whole rows, ``merge`` takes the
    fields that are not NULL. Columns that ``source`` lacks count as NULL."""
    if mode not in ("replace", "merge"):
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in target.columns if c != key]
    given = [c for c in others if c in source.columns]
    ours = target.select(F.col(key).alias("_t"), F.struct(*others).alias("t"))
    theirs = source.select(F.col(key).alias("_s"), F.struct(*given).alias("s") if given else F.lit(1).alias("s"))
    joined = ours.join(theirs, F.col("_t") == F.col("_s"), "full_outer")
    updated = F.col("_s").isNotNull()
    columns = [F.coalesce("_s", "_t").alias(key)]
    for c in others:
        new = F.col(f"s.{c}") if c in given else F.lit(None).cast(target.schema[c].dataType)
        old = F.col(f"t.{c}")
        value = F.when(updated, new).otherwise(old) if mode == "replace" else F.coalesce(new, old)
        columns.append(value.alias(c))
    return joined.select(*columns).select(*target.columns)


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "relpath", keys_column: str | None = None) -> DataFrame:
    """Rows of ``target`` whose key is not listed. The list is broadcast if it is small."""
    listed = broadcast_if_small(keys.select(F.col(keys_column or key).alias("_gone")))
    return target.join(listed, F.col(key) == F.col("_gone"), "left_anti")
