"""Best rows per question: ranking in Spark, and the accumulator that tasks use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUESTIONS_PER_SLICE = 512
ROWS_PER_SLICE = 8192


def rank_hits(
    scored: DataFrame, k: int | str, query: str = "query_id", score: str = "score", ties: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Rank 1..k per question by score, ties by the given columns.

    The first ranking is per question and task group, so that no single task receives
    the candidates of all tasks; each ranking drops rows beyond k before it shuffles.
    ``k`` may name a column.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    groups = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = Window.partitionBy(query, "_group").orderBy(*order)
    final = Window.partitionBy(query).orderBy(*order)
    return (
        scored.withColumn("_group", F.spark_partition_id() % groups)
        .withColumn("rank", F.row_number().over(local))
        .filter(F.col("rank") <= limit)
        .drop("_group", "rank")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= limit)
    )


def top_k(scored: DataFrame, k: int, score: str = "score", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k best rows of one question."""
    return scored.orderBy(F.desc(score), *[F.asc(t) for t in ties]).limit(k)


class BestRows:
    """The best rows seen so far for each of a bounded set of questions.

    Rows tie on the score often (copies of one text), so rows equal to the k-th score
    stay in play until the tie columns decide.
    """

    def __init__(self, limits: np.ndarray, tie_columns: list[str]):
        self.limits = limits
        self.tie_columns = tie_columns
        self.floor = np.full(len(limits), -np.inf)
        self.question = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.rows: pa.Table | None = None

    def offer(self, rows: pa.Table, scores: np.ndarray, first_question: int) -> None:
        """Scores are (rows x questions); -inf marks a row that a question must not see."""
        count = scores.shape[1]
        floor = self.floor[first_question : first_question + count]
        most = int(self.limits[first_question : first_question + count].max())
        candidate = (scores >= floor) & (scores > -np.inf)
        if np.count_nonzero(candidate) > 4 * most * count and scores.shape[0] > most:
            candidate &= scores >= np.partition(scores, -most, axis=0)[-most]
        row, question = np.nonzero(candidate)
        if row.size:
            self._merge(rows.take(pa.array(row)), scores[row, question], question + first_question)

    def _merge(self, rows: pa.Table, score: np.ndarray, question: np.ndarray) -> None:
        if self.rows is not None:
            rows = pa.concat_tables([self.rows, rows])
            score = np.concatenate([self.score, score])
            question = np.concatenate([self.question, question])
        keys = {f"tie{i}": rows.column(c) for i, c in enumerate(self.tie_columns)}
        sortable = pa.table({"question": question, "score": score, **keys})
        index = pc.sort_indices(
            sortable,
            sort_keys=[("question", "ascending"), ("score", "descending"), *[(t, "ascending") for t in keys]],
        ).to_numpy()
        question, score = question[index], score[index]
        starts = np.searchsorted(question, question, side="left")
        place = np.arange(len(question)) - starts
        keep = place < self.limits[question]
        self.question, self.score = question[keep], score[keep]
        self.rows = rows.take(pa.array(index[keep])).combine_chunks()
        last = place[keep] == self.limits[self.question] - 1
        self.floor[self.question[last]] = self.score[last]

    def batches(self, query_ids: pa.Array, score_name: str) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        out = self.rows.append_column(score_name, pa.array(self.score))
        out = out.append_column("k", pa.array(self.limits[self.question]))
        out = out.add_column(0, "query_id", query_ids.take(pa.array(self.question)))
        yield from out.combine_chunks().to_batches()
