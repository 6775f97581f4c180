"""Exact nearest-neighbour search for batches of questions.

Every task holds the vectors of one bounded set of questions, scores its rows against
them by matrix products, and passes on only its best rows per question. No pair of
question and row outlives its Arrow batch, and no row is shuffled unless it is among
the best of its task. Filters that are the same for all questions reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import values as V
from ..session import BROADCAST_BYTES, materialize, materialize_measured
from .topk import QUESTIONS_PER_SLICE, ROWS_PER_SLICE, BestRows, rank_hits

QUESTIONS_PER_PASS = 8192
QUESTION_BYTES_PER_PASS = 128 * 1024 * 1024
COSINE_PLACES = 9
PAYLOAD = ["source_file", "section", "date", "language", "content_preview"]


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without NULLs as a 2-d array of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.empty((0, 0))
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    if flat.size % len(vectors):
        raise ValueError("vectors of one search must have the same dimension")
    return flat.reshape(len(vectors), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


class Questions:
    """A bounded set of questions as arrays, shipped to every task."""

    def __init__(self, table: pa.Table, top_k: int):
        self.ids = table.column("query_id").combine_chunks()
        self.vectors = unit_rows(matrix(table.column("embedding")))

        def values(name: str) -> list:
            return table.column(name).to_pylist() if name in table.column_names else [None] * len(table)

        self.limits = np.array([top_k if k is None else k for k in values("top_k")], dtype=np.int64)
        self.filters = list(zip(values("after"), values("path_filter")))
        self.may_see: np.ndarray | None = None  # (questions x lists), inverted file only

    def __len__(self) -> int:
        return len(self.ids)

    def blocked(self, rows: pa.Table, first: int, count: int) -> np.ndarray | None:
        """True where a question's own filters exclude a row."""
        wanted = self.filters[first : first + count]
        if all(not a and not p for a, p in wanted):
            return None
        out = np.zeros((len(rows), count), dtype=bool)
        for after, path in set(wanted):
            passes = np.ones(len(rows), dtype=bool)
            if after:
                dates = pc.fill_null(rows.column("date"), "")
                passes &= pc.greater_equal(dates, after).to_numpy(zero_copy_only=False)
            if path:
                files = pc.fill_null(rows.column("source_file"), "")
                passes &= pc.match_substring(files, path).to_numpy(zero_copy_only=False)
            columns = [i for i, w in enumerate(wanted) if w == (after, path)]
            out[:, columns] = ~passes[:, None]
        return out


def question_passes(questions: DataFrame, width: Column, bytes_per_unit: int) -> list[DataFrame]:
    """Split questions so that each part fits the bound of one pass over the rows. ``width`` is
    measured on the widest question. Parts are ranges of a hash, cut where the questions' hashes
    say, so that all are of a size and no pass is spent on half a part."""
    size = questions.agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("widest")).first()
    count, width_bytes = size["n"], bytes_per_unit * (size["widest"] or 1)
    per_pass = max(1, min(QUESTIONS_PER_PASS, QUESTION_BYTES_PER_PASS // max(1, width_bytes)))
    if count <= per_pass:
        return [questions]
    passes = -(-count // max(1, per_pass - per_pass // 50))  # the cuts are right to a hundredth of that
    at = F.xxhash64("query_id")
    cuts = questions.agg(F.percentile_approx(at, [i / passes for i in range(1, passes)], 1_000_000).alias("c")).first()["c"]
    ends = zip([None, *cuts], [*cuts, None])
    return [
        questions.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        for low, high in ends
    ]


def each_pass(parts: list[DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One pass stays lazy. Several are run one after another and their hits written, so
    that the driver never holds more than one part of the questions."""
    if len(parts) == 1:
        return run(parts[0])
    return reduce(DataFrame.unionByName, [materialize(run(p)) for p in parts])


def best_rows(
    rows: DataFrame,
    questions,
    score: Callable[[pa.Table, int, int], np.ndarray],
    keep: list[str],
    ties: tuple[str, ...],
    query_type: T.DataType,
) -> DataFrame:
    """The best ``keep`` rows per task and question. ``score(rows, first, count)`` gives the
    scores of one slice of the questions."""
    limits, ids = questions.limits, questions.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(limits, list(ties))
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for start in range(0, len(whole), ROWS_PER_SLICE):
                part = whole.slice(start, ROWS_PER_SLICE)
                kept = part.select(keep)
                for first in range(0, len(limits), QUESTIONS_PER_SLICE):
                    count = min(QUESTIONS_PER_SLICE, len(limits) - first)
                    best.offer(kept, score(part, first, count), first)
        yield from best.batches(ids, "cosine")

    schema = T.StructType(
        [T.StructField("query_id", query_type)]
        + [T.StructField(rows.schema[c].name, rows.schema[c].dataType) for c in keep]
        + [T.StructField("cosine", T.DoubleType()), T.StructField("k", T.LongType())]
    )
    return rows.mapInArrow(run, schema)


def _dense_scorer(questions: Questions, vector: str, list_column: str | None):
    def score(rows: pa.Table, first: int, count: int) -> np.ndarray:
        vectors = unit_rows(matrix(rows.column(vector)))
        asked = questions.vectors[first : first + count]
        if list_column is None:
            cosine = vectors @ asked.T
        else:
            of_row = rows.column(list_column).to_numpy()
            may_see = questions.may_see[first : first + count]
            needed = np.flatnonzero(may_see[:, np.unique(of_row)].any(axis=1))
            cosine = np.full((len(rows), count), -np.inf)
            cosine[:, needed] = vectors @ asked[needed].T
            cosine[~may_see[:, of_row].T] = -np.inf
        # rounding makes rows with equal vectors tie whatever the order of addition
        cosine = np.round(cosine, COSINE_PLACES)
        blocked = questions.blocked(rows, first, count)
        if blocked is not None:
            cosine[blocked] = -np.inf
        return cosine

    return score


def nearest(
    chunks: DataFrame,
    questions: DataFrame,
    top_k: int = V.TOP_K,
    after: str | None = None,
    path_filter: str | None = None,
    vector: str = "embedding",
    payload: list[str] | None = None,
    ties: tuple[str, ...] = ("id",),
    probe: Callable[[Questions], np.ndarray] | None = None,
    list_column: str | None = None,
) -> DataFrame:
    """query_id, rank, score, cosine and the payload of the k nearest rows.

    ``questions`` has query_id and embedding, and may have top_k, after and path_filter
    of its own per question.
    """
    payload = [c for c in chunks.columns if c != vector] if payload is None else payload
    rows = chunks.filter(F.col(vector).isNotNull())
    if after:
        rows = rows.filter(S.on_or_after(F.col("date"), after))
    if path_filter:
        rows = rows.filter(S.path_contains(F.col("source_file"), path_filter))
    asked = [c for c in ("query_id", "embedding", "after", "path_filter", "top_k") if c in questions.columns]
    questions = questions.select(*asked).filter(F.col("embedding").isNotNull())
    query_type = questions.schema["query_id"].dataType
    own_filters = {"after": "date", "path_filter": "source_file"}
    needed = [own_filters[c] for c in asked if c in own_filters]
    keep = list(dict.fromkeys([*payload, *ties]))
    read = list(dict.fromkeys([*keep, *needed, vector, *([list_column] if list_column else [])]))

    def run(part: DataFrame) -> DataFrame:
        held = Questions(part.toArrow(), top_k)
        scan = rows
        if probe is not None:
            held.may_see = probe(held)
            wanted = np.flatnonzero(held.may_see.any(axis=0)).tolist()
            scan = rows.filter(F.col(list_column).isin(wanted))
        scored = best_rows(
            scan.select(*read), held, _dense_scorer(held, vector, list_column), keep, ties, query_type
        )
        limit = "k" if "top_k" in asked else top_k
        return rank_hits(scored, limit, score="cosine", ties=ties).drop("k")

    questions = materialize(questions)  # a lazy model would run again for each step
    hits = each_pass(question_passes(questions, F.size("embedding"), 8), run)
    return hits.withColumn("score", S.similarity_score(F.col("cosine")))


def search(
    chunks: DataFrame,
    questions: DataFrame,
    top_k: int = V.TOP_K,
    after: str | None = None,
    path_filter: str | None = None,
    full: bool = False,
    filter_mode: str = "pre",
) -> DataFrame:
    """Hits of a chunk table: query_id, rank, id, score, metadata, and the full text if asked.

    ``filter_mode='post'`` ranks first and filters afterwards, so that fewer than k hits
    may remain. Full texts are fetched for the hits alone.
    """
    payload = ["id", *PAYLOAD]
    ties = ("id", "source_file")
    if filter_mode == "pre":
        hits = nearest(chunks, questions, top_k, after, path_filter, payload=payload, ties=ties)
    elif filter_mode == "post":
        hits = post_filter(
            nearest(chunks, questions, top_k, payload=payload, ties=ties), after, path_filter, ties
        )
    else:
        raise ValueError(f"unknown filter_mode {filter_mode!r}")
    shown = ["query_id", "rank", "id", "score", *PAYLOAD]
    if not full:
        return hits.select(*shown, F.lit(None).cast("string").alias("full_text"))
    hits, _, size = materialize_measured(hits.select(*shown), "hits")
    texts = chunks.select(F.col("id").alias("_id"), F.col("source_file").alias("_file"), F.col("text").alias("full_text"))
    found = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    joined = texts.join(found, (F.col("_id") == F.col("id")) & (F.col("_file") == F.col("source_file")))
    return joined.dropDuplicates(["query_id", "rank"]).select(*shown, "full_text")


def post_filter(
    hits: DataFrame, after: str | None = None, path_filter: str | None = None, ties: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Filter hits that are already cut to k and number the rest again (at most k rows each)."""
    if after:
        hits = hits.filter(S.on_or_after(F.col("date"), after))
    if path_filter:
        hits = hits.filter(S.path_contains(F.col("source_file"), path_filter))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), *[F.asc(t) for t in ties])
    return hits.withColumn("rank", F.row_number().over(order))


def filter_after(df: DataFrame, after: str, date: str = "date") -> DataFrame:
    return df.filter(S.on_or_after(F.col(date), after))


def filter_path(df: DataFrame, part: str, source_file: str = "source_file") -> DataFrame:
    return df.filter(S.path_contains(F.col(source_file), part))


def filter_chunks(df: DataFrame, after: str | None = None, path_filter: str | None = None) -> DataFrame:
    """Both filters, one of them, or none."""
    if after:
        df = filter_after(df, after)
    return filter_path(df, path_filter) if path_filter else df


def flag_weak(hits: DataFrame, threshold: float = V.WEAK_SCORE) -> DataFrame:
    """Mark questions for which every hit scores below the threshold (k rows a question)."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("weak", best < threshold)
