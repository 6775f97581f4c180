"""Near-duplicate groups by one-permutation hashing.

Each document's set of word shingles is hashed once; the hash range is cut into bins and the
least hash of each bin kept. Empty bins borrow from a full bin that a fixed hash of (bin,
attempt) picks, so any two sets agree in a bin with their Jaccard similarity as probability.
Bands of bins form buckets. Equal sets are one class before that, and only class
representatives go on.

Within a bucket candidate pairs form a star: one hub against all others, confirmed on whole sets.
Groups of copies close with that. A star misses a link that does not touch its hub, so buckets
whose members are then in several components stay open, and their members are dealt anew, by their
rarest shingles. Two sets that link differ in few shingles; in any common order of the shingles
the first one they share therefore stands within a short prefix of both, and how far back it may
stand follows from the sizes. The order is by frequency among the open documents, so that documents
that share much, but too little to link, are kept apart by what each has of its own and meet
nowhere. Members whose shingle stands early are hubs in turn (1, 8, 64, ... at a time) until a
group is one component or all such members were hubs. Every pair that could link is met by that;
with 40 bands of 5 bins a pair at similarity 0.8 shares no bucket with probability 1e-7.

Defined results: texts without words link with nothing; null ids link with nothing and are
kept; rows that share an id are one document (repeated rows are kept or dropped together by
`groups`, while `dedup` keeps one); extra columns pass through `dedup`; empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bound_batches, measured_bytes
from .common import carried, column, written

BANDS, BINS_PER_BAND = 40, 5
ATTEMPTS = 1024
BROADCAST_BYTES = 8 << 20
#: Members of a hub that are compared in one group; more are split over several.
MEMBERS_PER_GROUP = 500
#: So many times more hubs in each round: rounds cost more than hubs, few of which meet a member.
GROWTH = 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hash of each word, kept for a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole text if it has fewer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    k = min(k, n)
    s = np.full(n - k + 1, k, np.uint64) * _M1
    for j in range(k):
        s = _mix(s + h[j : n - k + 1 + j]) * _M1
    return np.unique(_mix(s))


class OnePermutation:
    """Band keys of a set."""

    def __init__(self, bands: int = BANDS, rows: int = BINS_PER_BAND):
        self.shape, bins = (bands, rows), bands * rows
        self.bounds = np.array([-(-(i << 64) // bins) for i in range(bins)], np.uint64)
        grid = np.arange(ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
        self.choice = (_mix(grid * _M1 + _M3) % np.uint64(bins)).astype(np.int32)
        self.band = _mix(np.arange(bands, dtype=np.uint64) * _M1 + _M2)

    def keys(self, s: np.ndarray) -> np.ndarray:
        start = np.searchsorted(s, self.bounds)
        full = start < np.append(start[1:], len(s))
        values = np.zeros(len(full), np.uint64)
        values[full] = s[start[full]]
        empty = np.flatnonzero(~full)
        for attempts in (16, ATTEMPTS):
            if not len(empty):
                break
            picks = self.choice[:attempts, empty]
            good = full[picks]
            first = good.argmax(0)
            found = good[first, np.arange(len(empty))]
            values[empty[found]] = values[picks[first, np.arange(len(empty))][found]]
            empty = empty[~found]
        values[empty] = s[0] if len(s) else 0  # after so many misses: the least hash of all
        keys = self.band.copy()
        for column in values.reshape(self.shape).T:
            keys = _mix(keys + column) * _M1
        return keys.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set), bands; one pass over the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, oph = _WordHashes(), OnePermutation()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, k, hashes)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(oph.keys(s))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = np.arange(len(sizes) + 1, dtype=np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, similarity: int, id_col: str, text: str) -> DataFrame:
    """Of the pairs (hub, member) those with 100 * intersection >= similarity * union. Only the
    texts that some pair names are moved, once for each pair; hubs with many members are
    compared in several groups."""
    size = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    groups = size.select("hub", F.ceil(F.col("n") / MEMBERS_PER_GROUP).cast("int").alias("groups"))
    members = pairs.join(_small(groups), "hub").select(
        F.col("member").alias("id"),
        "hub",
        F.pmod(F.xxhash64("member"), F.col("groups")).cast("int").alias("part"),
        F.lit(1).alias("role"),
    )
    hubs = groups.select(
        F.col("hub").alias("id"),
        "hub",
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"),
        F.lit(0).alias("role"),
    )
    wanted = written(members.unionByName(hubs), "pairs")
    texts = docs.select(column(docs, id_col).cast("bigint").alias("id"), column(docs, text).cast("string").alias("text"))
    dealt = (
        texts.join(_small(wanted), "id")
        .repartition("hub", "part")
        .sortWithinPartitions("hub", "part", "role")
        .select("hub", "part", "role", "id", "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, base = _WordHashes(), None, None
        for batch in batches:
            hub, part, role, ids = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, t in enumerate(batch.column(4).to_pylist()):
                s = shingle_set(t, k, hashes)
                if role[i] == 0:
                    at, base = (hub[i], part[i]), s
                elif at == (hub[i], part[i]):
                    shared = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * shared >= similarity * (len(base) + len(s) - shared):
                        out.append((hub[i], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for each node of an edge (a, b), by
    alternating large and small stars; every round is written."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())

    pair = lambda x, y: (F.greatest(x, y).alias("node"), F.least(x, y).alias("root"))
    e = written(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    seen = state(e)
    while seen[0]:
        both = e.union(e.select("root", "node"))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("root > node and root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").select(
            F.explode(F.array(F.struct(F.col("node"), F.col("m").alias("root")), F.struct(F.col("root").alias("node"), F.col("m").alias("root")))).alias("e")
        )
        e = written(small.select("e.*").where("node <> root").distinct(), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e


def rare_shingles(texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """rep, n, key, pos, hub: the shingles in a document's prefix that some other document has too.
    ``pos`` is a shingle's place (from 0) in the order of frequency, ``hub`` tells whether a pair
    with a set of the same size or larger can first meet there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for i, rep in enumerate(batch.column(0).to_pylist()):
                s = shingle_set(batch.column(1)[i].as_py(), k, hashes)
                columns = [np.full(len(s), rep, np.int64), np.full(len(s), len(s), np.int32), s.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "n", "key"])

    rows = written(texts.select("rep", "text").mapInArrow(run, "rep bigint, n int, key bigint"), "shingles")
    shared = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = rows.join(shared, "key")
    mine = Window.partitionBy("rep")
    alone = F.col("n") - F.count("*").over(mine)  # shingles that nobody shares come first
    place = alone + F.row_number().over(mine.orderBy("df", "key")) - 1
    s, n = similarity, F.col("n")
    most = n - F.ceil(s * n / 100)
    most_as_smaller = n - F.ceil(2 * s * n / (100 + s))
    found = held.withColumn("pos", place.cast("int")).where(F.col("pos") <= most)
    return found.select("rep", "n", "key", "pos", (F.col("pos") <= most_as_smaller).alias("hub"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``rank``, the place (from 1) among the rows of their key in the order of a hash of
    rep: by slices of the hash, so that a key with very many rows is ranked in many tasks."""
    h = F.xxhash64("rep")
    sliced = rows.withColumn("h", h).withColumn("slice", F.shiftright("h", 58))
    counts = sliced.groupBy("key", "slice").agg(F.count("*").alias("c"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("key", "slice").orderBy("h", "rep"))
    return sliced.withColumn("local", local).join(offsets, ["key", "slice"]).withColumn(
        "rank", F.col("before") + F.col("local")
    ).drop("h", "slice", "before", "local")


def _labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows with ``comp``, the component of their rep so far."""
    if label is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _joined(links: DataFrame, pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """rep, comp after links (a, b) between the pairs' documents."""
    edges = links.join(pairs, (F.col("a") == F.col("hub")) & (F.col("b") == F.col("member"))).select(
        F.col("hub_comp").alias("a"), F.col("member_comp").alias("b")
    )
    roots = components(edges)
    if label is None:
        return roots.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    moved = label.join(roots, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    fresh = roots.join(label.select("rep"), F.col("node") == F.col("rep"), "left_anti")
    return moved.unionByName(fresh.select(F.col("node").alias("rep"), F.col("root").alias("comp")))


def _open(rows: DataFrame) -> DataFrame:
    """Rows (with key and comp) of the keys whose rows are in several components."""
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return rows.join(several.select("key"), "key", "left_semi")


def _first_stars(members: DataFrame, docs: DataFrame, k: int, similarity: int, id_col: str, text: str) -> DataFrame | None:
    """rep, comp once each bucket's first member was compared with the others."""
    first = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep"), F.col("n"))).alias("first")
    hubs = members.groupBy("key").agg(first).select("key", F.col("first.rep").alias("hub"), F.col("first.n").alias("hub_n"))
    pairs = (
        members.join(hubs, "key")
        .where((F.col("rep") != F.col("hub")) & (100 * F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")))
        .select("hub", F.col("rep").alias("member"), F.col("hub").alias("hub_comp"), F.col("rep").alias("member_comp"))
        .distinct()
    )
    pairs = written(pairs, "stars")
    if pairs.isEmpty():
        return None
    links = written(confirmed(pairs.select("hub", "member"), docs, k, similarity, id_col, text), "links")
    return written(_joined(links, pairs, None), "labels")


def _later_stars(members: DataFrame, label: DataFrame | None, texts: DataFrame, k: int, similarity: int) -> DataFrame | None:
    """rep, comp once the rows of ``members`` (rep, n, key, pos, hub) have been hubs in turn."""
    ranks = _numbered(members.where("hub").select("rep", "key"))
    members = written(members.drop("hub").join(ranks, ["rep", "key"], "left"), "members")
    first, hubs, s = 1, 1, similarity
    while True:
        left = written(_open(_labelled(members.where(f"rank is null or rank >= {first}"), label)), "open")
        hub = left.where(F.col("rank") < first + hubs).select(
            F.col("key").alias("at"), F.col("rep").alias("hub"), F.col("comp").alias("hub_comp"), F.col("rank").alias("hub_rank"),
            F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"),
        )
        both = F.col("n") + F.col("hub_n")
        near = ((100 + s) * (F.col("n") - F.col("pos")) >= s * both) & ((100 + s) * (F.col("hub_n") - F.col("hub_pos")) >= s * both)
        sizes = 100 * F.least("n", "hub_n") >= s * F.greatest("n", "hub_n")
        turn = F.col("rank").isNull() | (F.col("rank") > F.col("hub_rank"))
        pairs = (
            left.join(hub, (F.col("key") == F.col("at")) & turn & (F.col("comp") != F.col("hub_comp")) & sizes & near)
            .select("hub", F.col("rep").alias("member"), "hub_comp", F.col("comp").alias("member_comp"))
            .distinct()
        )
        pairs = written(pairs, "stars")
        if not pairs.isEmpty():
            links = written(confirmed(pairs.select("hub", "member"), texts, k, similarity, "rep", "text"), "links")
            label = written(_joined(links, pairs, label), "labels")
        first, hubs = first + hubs, GROWTH * hubs
        if left.where(F.col("rank") >= first).isEmpty():
            return label


def groups(
    docs: DataFrame, k: int = 5, similarity: int = 80, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id that can be reached by links of at
    least `similarity` per cent), kept (the id is its component's)."""
    if not 80 <= similarity <= 100:
        raise ValueError("the bands are set for a similarity of 80 per cent or more")
    sig = written(signatures(docs, k, id_col, text), "signatures")
    keyed = sig.where("doc_id is not null and n_shingles > 0")
    classes = keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    # Sets under 4 shingles link at 0.8 only when equal.
    reps = keyed.where("n_shingles >= 4").join(classes, "set_key").where("doc_id = rep")
    reps = reps.select("rep", F.col("n_shingles").alias("n"), "bands").distinct()
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = written(rows.join(_small(written(shared, "buckets")), "key"), "members")
    label = _first_stars(members, docs, k, similarity, id_col, text)
    still = written(_open(_labelled(members, label)).select("rep").distinct(), "still")
    if not still.isEmpty():
        texts = docs.select(column(docs, id_col).cast("bigint").alias("rep"), column(docs, text).cast("string").alias("text"))
        texts = texts.join(_small(still), "rep", "left_semi")
        rows_of_id = keyed.join(_small(still), F.col("doc_id") == F.col("rep"), "left_semi").groupBy("doc_id").count()
        if not rows_of_id.where("count > 1").isEmpty():
            texts = texts.groupBy("rep").agg(F.min("text").alias("text"))
        texts = written(texts, "texts")
        label = _later_stars(rare_shingles(texts, k, similarity), label, texts, k, similarity)
    out = sig.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    out = out.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    if label is not None:
        out = out.join(label.select(F.col("rep").alias("r"), "comp"), F.col("rep") == F.col("r"), "left")
        component = F.coalesce("comp", "rep")
    else:
        component = F.col("rep")
    out = out.withColumn("component_id", component)
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def dedup(docs: DataFrame, k: int = 5, similarity: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but one of each group, with their own columns."""
    doc, back = carried(docs)
    rows = docs.select(doc, column(docs, id_col).cast("bigint").alias("id"), column(docs, text).alias("text"))
    found = written(groups(rows.select("id", "text"), k, similarity, "id", "text"), "groups")
    drop = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    kept = rows.drop("text").join(_small(drop), F.col("id") == F.col("gone"), "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    again = written(again, "repeated")
    if again.isEmpty():
        return kept.select(*back)
    once = kept.join(again, F.col("id") == F.col("again"), "left_semi").dropDuplicates(["id"])
    return kept.join(again, F.col("id") == F.col("again"), "left_anti").unionByName(once).select(*back)
