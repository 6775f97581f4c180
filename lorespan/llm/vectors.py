"""Exact nearest neighbours over a vector-approximation file.

Components become integers, floor(scale * x). For each dimension the range of all vectors is cut
into cells of one width, and the file holds a byte per component: the number of its cell. From a
cell the inner product with a question is known up to a distance that depends on the question
alone, so one matrix product over the cells bounds every score from both sides.

1. Scan: questions and rows of the file meet in tiles (a bounded group of questions, a chunk of
   rows). A tile passes on the rows whose upper bound reaches the k-th largest lower bound it saw.
2. The k-th largest lower bound over all tiles drops most of these.
3. Read: the exact vectors of what is left are fetched in the order of their bounds, in growing
   steps, until no unread row's upper bound reaches a question's k-th exact score.

No answer depends on the cells; they only decide how much is read. Of equal vectors the k + 1
least ids can be hits, so a vector that a third of all rows share adds k + 1 rows to the file.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do null ids or components beyond 65,536 (their products could leave a long). Vectors are
compared with those of their own length. Equal rows count once; rows that share an id with a
question are its own and no hits of it; of several question rows with one id the least vector is
asked. Ties go to the smaller id. Extra columns are not read. Without questions or rows the result
is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, written

BITS = 6
QUESTIONS_PER_GROUP = 8_192
ROWS_PER_CHUNK = 1_000_000
#: Smaller chunks only pass on more rows that are not among the best of all.
LEAST_ROWS = 4_096
#: Scores that a task holds at once.
SCORES = 4 << 20
LARGEST = 65_536.0
#: Wanted rows are dealt by this many parts of the questions, so that a vector near very many
#: questions is read in as many tasks.
PARTS = 32


def _valid(vector: Column) -> Column:
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, fits), F.lit(False))


def integers(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """id, n (components), q (the components as integers) of the rows that take part."""
    rows = df.select(column(df, id_col).cast("bigint").alias("id"), column(df, vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("v")))
    q = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return rows.select("id", F.size("v").alias("n"), q.alias("q"))


def cell_ranges(rows: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the least value and the cell width of every dimension: twice as
    many numbers as a vector has, whatever the number of rows."""
    found = (
        rows.select("n", F.posexplode("q").alias("pos", "x"))
        .groupBy("n", "pos")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("n", "pos")
        .collect()
    )
    ranges = {}
    for n in {r.n for r in found}:
        low = np.array([r.low for r in found if r.n == n], np.int64)
        high = np.array([r.high for r in found if r.n == n], np.int64)
        ranges[n] = (low, -(-(high - low + 1) // (1 << bits)))
    return ranges


def approximations(rows: DataFrame, ranges: dict) -> DataFrame:
    """The file: id, n, h, and a byte for each component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for q in batch.column(3).to_pylist():
                low, width = ranges[len(q)]
                cells.append(((np.array(q, np.int64) - low) // width).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.binary())], ["id", "n", "h", "cells"])

    return rows.select("id", "n", "h", "q").mapInArrow(run, "id bigint, n int, h bigint, cells binary")


class _Tile:
    """One group of questions against a chunk of the file."""

    def __init__(self, k: int, bits: int, ranges: tuple[np.ndarray, np.ndarray]):
        self.k, self.cells, (self.low, self.width) = k, 1 << bits, ranges
        self.ids: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.q = None

    def ask(self, ids: list[int], data: list[bytes]) -> None:
        self.ids += ids
        self.vectors += [np.frombuffer(d, "<i4") for d in data]

    def _begin(self) -> None:
        order = np.argsort(self.ids)
        self.ids = np.array(self.ids, np.int64)[order]
        q = np.array(self.vectors, np.float64)[order]
        radius = (self.width - 1) / 2
        most = np.abs(q).max() * np.maximum(np.abs(self.low), np.abs(self.low + self.cells * self.width)).sum()
        # half integers below 2^23 are exact in single precision, and below 2^52 in double
        self.q = q.astype(np.float32) if most < 1 << 22 else q
        slack = 0.0 if most < 1 << 51 else most * 1e-9
        self.error = np.abs(q) @ radius + slack
        self.floor = np.full(len(q), -np.inf)  # k-th largest middle so far
        self.best = np.full((len(q), self.k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def offer(self, ids: np.ndarray, hashes: np.ndarray, cells: np.ndarray) -> None:
        if self.q is None:
            self._begin()
        step = max(1, SCORES // max(1, len(self.q)))
        for i in range(0, len(ids), step):
            some = slice(i, i + step)
            middle = (self.low + cells[some] * self.width + (self.width - 1) / 2).astype(self.q.dtype)
            self._merge(self.q @ middle.T, ids[some], hashes[some])

    def _merge(self, scores: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        at = np.searchsorted(self.ids, ids)
        own = np.flatnonzero(self.ids[np.minimum(at, len(self.ids) - 1)] == ids)
        scores[at[own], own] = -np.inf  # a question's own rows
        if scores.shape[1] >= self.k and not np.isfinite(self.floor).all():
            rough = np.partition(scores, -self.k, axis=1)[:, -self.k].astype(np.float64)
            limit = np.maximum(self.floor, rough)
        else:
            limit = self.floor
        reach = limit - 2 * self.error
        question, row = np.nonzero((scores >= reach[:, None].astype(scores.dtype)) & (scores > -np.inf))
        middle = scores[question, row].astype(np.float64)
        self.held.append((question, ids[row], hashes[row], middle))
        self.count += len(row)
        self._raise(question, middle)
        if self.count > SCORES:
            self._prune()

    def _raise(self, question: np.ndarray, middle: np.ndarray) -> None:
        better = middle > self.best[question, 0]
        question, middle = question[better], middle[better]
        touched = np.unique(question)
        question = np.concatenate([question, np.repeat(touched, self.k)])
        middle = np.concatenate([middle, self.best[touched].ravel()])
        order = np.lexsort((-middle, question))
        question, middle = question[order], middle[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        keep = place < self.k
        self.best[question[keep], self.k - 1 - place[keep]] = middle[keep]
        self.floor = self.best[:, 0].copy()

    def _prune(self) -> None:
        question, ids, hashes, middle = (np.concatenate(c) for c in zip(*self.held))
        keep = middle >= (self.floor - 2 * self.error)[question]
        self.held = [(question[keep], ids[keep], hashes[keep], middle[keep])]
        self.count = int(keep.sum())

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.q is None or not self.held:
            return
        self._prune()
        question, ids, hashes, middle = self.held[0]
        error = self.error[question]
        columns = [self.ids[question], ids, hashes, middle - error, middle + error]
        names = ["query_id", "id", "h", "lower", "upper"]
        table = pa.table(dict(zip(names, map(pa.array, columns))))
        yield from table.to_batches(max_chunksize=65_536)


def bounds(
    file: DataFrame, questions: DataFrame, ranges: dict, k: int, bits: int, tiles: tuple[int, int]
) -> DataFrame:
    """query_id, id, h, lower, upper: per tile the rows that may be among a question's k best."""
    groups, chunks = tiles

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(q, "<i4").tobytes() for q in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["id", "n", "data"])

    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    part = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    asked = questions.select("id", "n", "q").mapInArrow(packed, "id bigint, n int, data binary").select(
        "n", part("id", groups).alias("grp"), each(chunks).alias("chunk"), F.lit(0).alias("role"), "id", F.lit(0).cast("bigint").alias("h"), "data"
    )
    rows = file.select("n", each(groups).alias("grp"), part("id", chunks).alias("chunk"), F.lit(1).alias("role"), "id", "h", F.col("cells").alias("data"))
    dealt = asked.unionByName(rows).repartition(groups * chunks, "n", "grp", "chunk").sortWithinPartitions("n", "grp", "chunk", "role")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at = None, None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin == end:
                    continue
                n, *place = (int(x) for x in key[:3, begin])
                if (n, *place) != at:
                    if tile is not None:
                        yield from tile.result()
                    tile, at = _Tile(k, bits, ranges[n]) if n in ranges else None, (n, *place)
                if tile is None:  # no row has as many components
                    continue
                some = batch.slice(begin, end - begin)
                if key[3, begin] == 0:
                    tile.ask(some.column(4).to_pylist(), some.column(6).to_pylist())
                elif len(tile.ids):
                    cells = np.frombuffer(b"".join(some.column(6).to_pylist()), np.uint8).reshape(-1, n).astype(np.int64)
                    tile.offer(some.column(4).to_numpy(), some.column(5).to_numpy(), cells)
                else:  # nobody asks here
                    tile = None
        if tile is not None:
            yield from tile.result()

    return dealt.mapInArrow(run, "query_id bigint, id bigint, h bigint, lower double, upper double")


def _exact(wanted: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, id, score of the wanted rows; each vector is fetched once for a part of the
    questions."""
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(PARTS)).cast("int"))
    fetched = rows.join(wanted.select("id", "h", "part").distinct(), ["id", "h"]).select("id", "h", "part", "q")
    asked = questions.select(F.col("id").alias("query_id"), F.col("q").alias("asked"))
    both = wanted.join(fetched, ["id", "h", "part"]).join(asked, "query_id")
    products = F.zip_with("q", "asked", lambda a, b: a.cast("bigint") * b)
    return both.select("query_id", "id", F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("score"))


def search(
    vectors: DataFrame,
    questions: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    bits: int = BITS,
) -> DataFrame:
    """query_id, rank, id, score: the k rows of ``vectors`` with the largest inner product for
    each row of ``questions`` (both with ``id_col`` and ``vector``), itself excluded."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell number has 1 to 8 bits")
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector, scale).distinct()
    alike = Window.partitionBy("q").orderBy("id")
    rows = rows.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).drop("r")
    rows = written(rows.withColumn("h", F.xxhash64("q")), "vectors")
    asked = integers(questions, id_col, vector, scale).groupBy("id").agg(F.min("q").alias("q"))
    asked = written(asked.withColumn("n", F.size("q")), "questions")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-asked.count() // QUESTIONS_PER_GROUP))
    count = rows.count()
    chunks = max(1, -(-count // ROWS_PER_CHUNK), min(-(-tasks // groups), count // LEAST_ROWS))
    ranges = cell_ranges(rows, bits)
    file = written(approximations(rows, ranges), "va-file")
    seen = written(bounds(file, asked, ranges, k, bits, (groups, chunks)), "bounds")
    mine = Window.partitionBy("query_id")
    place = F.row_number().over(mine.orderBy(F.desc("lower"), "id", "h"))
    kth = F.max(F.when(F.col("place") == k, F.col("lower"))).over(mine)
    left = seen.withColumn("place", place).withColumn("kth", kth).where("kth is null or upper >= kth")
    order = F.row_number().over(mine.orderBy(F.desc("upper"), "id", "h"))
    left = written(left.select("query_id", "id", "h", "upper", order.alias("place")), "possible")
    best, step, at = None, 4 * k, 0
    ranked = F.row_number().over(mine.orderBy(F.desc("score"), "id"))
    while True:
        scored = _exact(left.where(F.col("place") <= at + step), rows, asked)
        scored = scored if best is None else scored.unionByName(best.drop("rank"))
        best = written(scored.withColumn("rank", ranked).where(F.col("rank") <= k), "best")
        sure = best.where(F.col("rank") == k).select("query_id", "score")
        left = left.where(F.col("place") > at + step).join(sure, "query_id", "left")
        left = written(left.where("score is null or upper >= score").drop("score"), "possible")
        if left.isEmpty():
            return best.select("query_id", "rank", "id", "score")
        at, step = at + step, 4 * step
