"""Approximate search over an inverted file: rows are grouped by their nearest centroid
and a question looks only into the lists nearest to it.

A quantised file also holds a short code for each row: what is left of its vector beside the
centroid, cut into parts, each replaced by the nearest of 256 patterns. A search scans the codes of
its lists, a byte for each part, and reads the vectors of the best rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType

from ..functions import scalars as S
from ..functions import values as V
from ..session import BROADCAST_BYTES, materialize, materialize_measured
from .search import COSINE_PLACES, Questions, best_rows, each_pass, matrix, nearest, question_passes, unit_rows
from .topk import rank_hits

PRODUCT_CELLS = 8 << 20
#: The patterns of the codes are fitted to about so many rows, chosen by a hash of the vector; all
#: rows are coded.
SAMPLE_ROWS = 65_536
PATTERNS = 256

def train_centroids(
    chunks: DataFrame, n_lists: int, vector: str = "embedding", seed: int = 7, max_iter: int = 10
) -> np.ndarray:
    """Unit centroids (n_lists x dim), trained on all rows that have a vector."""
    rows = chunks.select(vector).filter(F.col(vector).isNotNull())
    features = rows.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(features)
    return unit_rows(np.array(model.clusterCenters()))


def build_ivf(chunks: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every row with the number of its nearest list."""

    @F.arrow_udf(IntegerType())
    def nearest_list(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.int32())
        unit = unit_rows(matrix(vectors))
        rows = max(1, PRODUCT_CELLS // len(centroids))  # so many at a time
        best = [np.argmax(unit[i : i + rows] @ centroids.T, axis=1) for i in range(0, len(unit), rows)]
        return pa.array(np.concatenate(best).astype(np.int32))

    return chunks.filter(F.col(vector).isNotNull()).withColumn("list_id", nearest_list(F.col(vector)))


def write_ivf(indexed: DataFrame, path: str) -> None:
    """One directory per list. Rebalancing joins small lists' rows in one task and splits
    those of a list that holds a large share over several tasks and files."""
    indexed.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def search_ivf(
    indexed: DataFrame,
    questions: DataFrame,
    centroids: np.ndarray,
    nprobe: int,
    top_k: int = V.TOP_K,
    **options,
) -> DataFrame:
    """The k nearest rows within the nprobe nearest lists of each question. Over a table
    written by ``write_ivf`` the scan opens only lists that some question looks into;
    with all lists the result is that of the exact search."""

    def probe(held: Questions) -> np.ndarray:
        closest = np.argsort(-(held.vectors @ centroids.T), axis=1, kind="stable")[:, :nprobe]
        may_see = np.zeros((len(held), len(centroids)), dtype=bool)
        np.put_along_axis(may_see, closest, True, axis=1)
        return may_see

    options.setdefault("payload", [c for c in indexed.columns if c not in ("embedding", "list_id")])
    return nearest(indexed, questions, top_k, probe=probe, list_column="list_id", **options)


@dataclass(frozen=True)
class Quantizer:
    """Centroids (lists x dim) and the patterns (parts x 256 x width) of what is left beside them."""

    centroids: np.ndarray
    patterns: np.ndarray

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.patterns.shape
        padded = np.zeros((len(vectors), parts * width))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), parts, width)

    def codes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = self._parts(unit - self.centroids[lists])
        out = np.empty(left.shape[:2], np.uint8)
        for part, patterns in enumerate(self.patterns):
            size = (patterns**2).sum(axis=1)
            out[:, part] = np.argmin(size - 2 * left[:, part] @ patterns.T, axis=1)
        return out

    def tables(self, asked: np.ndarray) -> np.ndarray:
        """Products (questions x parts x 256) of questions with the patterns."""
        return np.einsum("qpw,pcw->qpc", self._parts(asked), self.patterns, optimize=True).astype(np.float32)


def _clustered(points: np.ndarray, count: int, draw: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds."""
    centres = points[draw.choice(len(points), count, replace=len(points) < count)].copy()
    for _ in range(rounds):
        nearest_of = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        held = np.bincount(nearest_of, minlength=count)
        for axis in range(points.shape[1]):
            total = np.bincount(nearest_of, points[:, axis], minlength=count)
            centres[held > 0, axis] = total[held > 0] / held[held > 0]
    return centres


def train_quantizer(
    chunks: DataFrame, n_lists: int, parts: int = 16, vector: str = "embedding", seed: int = 7, sample_rows: int = SAMPLE_ROWS
) -> Quantizer:
    """Centroids of all rows, and patterns fitted to a bounded sample of them."""
    rows = chunks.select(vector).filter(F.col(vector).isNotNull())
    centroids = train_centroids(chunks, n_lists, vector, seed)
    share = min(1.0, sample_rows / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * sample_rows)
    held = some.toArrow().column(0)
    unit = unit_rows(matrix(held)) if len(held) else np.zeros((1, centroids.shape[1]))
    left = unit - centroids[np.argmax(unit @ centroids.T, axis=1)]
    width = -(-left.shape[1] // parts)
    padded = np.zeros((len(left), parts * width))
    padded[:, : left.shape[1]] = left
    draw = np.random.default_rng(seed)
    cut = padded.reshape(len(left), parts, width)
    return Quantizer(centroids, np.stack([_clustered(cut[:, p], PATTERNS, draw) for p in range(parts)]))


def build_quantized(chunks: DataFrame, quantizer: Quantizer, vector: str = "embedding") -> DataFrame:
    """Every row with its list and its code. Written by ``write_ivf``, a scan of the codes reads
    no vector."""

    @F.arrow_udf(BinaryType())
    def code(vectors: pa.Array, lists: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.binary())
        return pa.array([c.tobytes() for c in quantizer.codes(unit_rows(matrix(vectors)), lists.to_numpy())], pa.binary())

    return build_ivf(chunks, quantizer.centroids, vector).withColumn("code", code(F.col(vector), F.col("list_id")))


def _code_scorer(questions: Questions, quantizer: Quantizer):
    parts = quantizer.patterns.shape[0]

    def score(rows: pa.Table, first: int, count: int) -> np.ndarray:
        out = np.full((len(rows), count), -np.inf)
        asked = questions.vectors[first : first + count]
        tables = quantizer.tables(asked)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        of_row = rows.column("list_id").to_numpy()
        for number in np.unique(of_row):
            some = np.flatnonzero(of_row == number)
            seen = np.flatnonzero(questions.may_see[first : first + count, number])
            if not len(seen):
                continue
            found = np.repeat((asked[seen] @ quantizer.centroids[number])[:, None], len(some), axis=1)
            for part in range(parts):
                found += tables[seen, part][:, codes[some, part]]
            out[np.ix_(some, seen)] = found.T
        return out

    return score


def search_quantized(
    indexed: DataFrame,
    questions: DataFrame,
    quantizer: Quantizer,
    nprobe: int,
    top_k: int = V.TOP_K,
    refine: int = 20,
    key: str = "id",
    vector: str = "embedding",
    payload: list[str] | None = None,
) -> DataFrame:
    """query_id, rank, key, cosine, score and the payload of the nearest rows within the nprobe
    nearest lists. Of each question the ``refine * top_k`` best rows by code are compared by their
    vectors. ``key`` must be unique."""
    asked = materialize(questions.select("query_id", "embedding").filter(F.col("embedding").isNotNull()))
    query_type = asked.schema["query_id"].dataType

    @F.arrow_udf(DoubleType())
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.round((unit_rows(matrix(a)) * unit_rows(matrix(b))).sum(axis=1), COSINE_PLACES))

    def run(part: DataFrame) -> DataFrame:
        held = Questions(part.toArrow(), refine * top_k)
        if not len(held):
            held.vectors = np.empty((0, quantizer.centroids.shape[1]))
        closest = np.argsort(-(held.vectors @ quantizer.centroids.T), axis=1, kind="stable")[:, :nprobe]
        held.may_see = np.zeros((len(held), len(quantizer.centroids)), dtype=bool)
        np.put_along_axis(held.may_see, closest, True, axis=1)
        opened = F.col("list_id").isin(np.flatnonzero(held.may_see.any(axis=0)).tolist())
        scan = indexed.filter(opened).select(key, "list_id", "code")
        rough = best_rows(scan, held, _code_scorer(held, quantizer), [key, "list_id"], (key,), query_type)
        best = rank_hits(rough, refine * top_k, score="cosine", ties=(key,)).select(
            "query_id", F.col(key).alias("_key"), F.col("list_id").alias("_list")
        )
        best, _, size = materialize_measured(best, "rough-hits")
        best = F.broadcast(best) if size <= BROADCAST_BYTES else best
        rows = indexed.filter(opened).select(key, "list_id", vector, *(payload or []))
        both = rows.join(best, (F.col("list_id") == F.col("_list")) & (F.col(key) == F.col("_key")))
        both = both.join(F.broadcast(part.select("query_id", F.col("embedding").alias("_asked"))), "query_id")
        exact = both.select("query_id", key, *(payload or []), cosine(F.col(vector), F.col("_asked")).alias("cosine"))
        return rank_hits(exact, top_k, score="cosine", ties=(key,))

    hits = each_pass(question_passes(asked, F.size("embedding"), 8), run)
    return hits.withColumn("score", S.similarity_score(F.col("cosine")))


def recall(approximate: DataFrame, exact: DataFrame, id_column: str = "id") -> DataFrame:
    """Share of the exact hits that the approximate search found, over all questions."""
    pair = ["query_id", id_column]
    found = exact.select(*pair).join(approximate.select(*pair, F.lit(1).alias("hit")), pair, "left")
    return found.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
