"""Language-model scores by deleted interpolation.

A bigram model: the maximum-likelihood estimates of the bigram, of the word, and a uniform
share are mixed with weights that depend on how often the context was seen (by powers of two).
The weights are learned by expectation-maximisation on a deleted part of the training texts:
there, counts are taken without that part.

Texts become blocks of about a million words, kept as hashed words (64 bits) and written once.
A block sends each distinct word and bigram of its own once, with its count, to the hash range
that owns it; the range adds up all blocks and answers each with the totals of its keys. So hot
words cost one entry per block, ranges are even, and no vocabulary is ever in one place.

The EM works on held-out counts in cells of (context bucket, bigram and word probability in
steps of an eighth of an octave). Their number is bounded by the grid, whatever the corpus.

Defined results: a null or empty text is its end token alone; a null id is never learned from
and counts as held out; repeated rows are learned and scored each; extra columns are not read;
an empty table gives no rows; without training texts all words are unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, column, written
from .neardup import _M1, _M2, _mix, _WordHashes

BLOCK_TOKENS = 1_000_000
END = np.uint64(0x5851F42D4C957F2D)
HELD_OUT, DELETED = 0, 1
FOLDS = 10
BUCKETS = 40
STEPS = 8
EM_ROUNDS = 60
LEAST_WEIGHT = 1e-9

BLOCK_SCHEMA = "block bigint, n_tokens bigint, ids binary, has_id binary, sizes binary, folds binary, words binary, tokens binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by byte planes; leading zeros cost nearly nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def fold(doc_id: int | None) -> int:
    return HELD_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


class _Block:
    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.count = 0

    def add(self, doc_id: int | None, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(hashes))
        self.tokens.append(hashes)
        self.count += len(hashes)

    def row(self, number: int) -> pa.RecordBatch:
        words, at, count = np.unique(np.concatenate(self.tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        values = [
            number,
            self.count,
            np.array([i or 0 for i in self.ids], "<i8").tobytes(),
            np.array([i is not None for i in self.ids], bool).tobytes(),
            pack(np.array(self.sizes)),
            np.array([fold(i) for i in self.ids], np.uint8).tobytes(),
            words[order].tobytes(),
            pack(rank[at]),
        ]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Deleted texts have blocks of their own, with odd numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, made = _WordHashes(), [_Block(), _Block()], 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                for doc, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    found = (t or "").encode().lower().split()
                    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                    odd = int(doc is not None and fold(doc) == DELETED)
                    held[odd].add(doc, np.append(h, END))
                    if held[odd].count >= BLOCK_TOKENS:
                        yield held[odd].row(2 * (first + made) + odd)
                        held[odd], made = _Block(), made + 1
        for odd, block in enumerate(held):
            if block.count:
                yield block.row(2 * (first + made) + odd)
                made += 1

    rows = docs.select(column(docs, id_col).cast("bigint"), column(docs, text).cast("string"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


class _Tokens:
    """A written block: words and bigrams as positions in sorted distinct keys."""

    def __init__(self, row: dict):
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.folds = np.frombuffer(row["folds"], np.uint8)
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = words[order]
        self.word = rank[unpack(row["tokens"]).astype(np.int64)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        h = self.words[self.word]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = END
        self.bigrams, self.bigram = np.unique(_mix(_mix(before * _M1) + h * _M2), return_inverse=True)
        end = np.searchsorted(self.words, END)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = end  # a text begins after an end


def requests(held: DataFrame, ranges: int) -> DataFrame:
    """Rows (kind, range, block): sorted distinct keys and their counts in training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "range", "block", "keys", "counts"]
        for batch in batches:
            for row in batch.to_pylist():
                block = _Tokens(row)
                learn = np.repeat(block.folds != HELD_OUT, block.sizes)
                out = []
                for kind, keys, at in ((0, block.words, block.word), (1, block.bigrams, block.bigram)):
                    count = np.bincount(at[learn], minlength=len(keys))
                    where = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = np.flatnonzero(np.diff(where)) + 1
                    for r, k, c in zip(where[np.append(0, cuts)], np.split(keys, cuts), np.split(count, cuts)):
                        out.append((kind, int(r), row["block"], pack_sorted(k), pack(c)))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return held.mapInArrow(run, "kind int, range int, block bigint, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """For each request the totals of its keys (for odd blocks also those of the deleted part);
    with one row of each range its number of known keys and of training tokens."""

    def run(table: pa.Table) -> pa.Table:
        kind, where = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        block = np.array(table.column("block").to_pylist(), np.int64)
        keys = [unpack_sorted(k.as_py()) for k in table.column("keys")]
        counts = [unpack(c.as_py()).astype(np.float64) for c in table.column("counts")]
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate(counts)
        odd = np.repeat(block & 1, sizes)
        total = np.bincount(at, count, len(distinct)).astype(np.uint64)
        deleted = np.bincount(at, count * odd, len(distinct)).astype(np.uint64)
        split = np.split(at, np.cumsum(sizes)[:-1])
        n = len(block)
        figures = [
            np.append((total > 0).sum(), np.zeros(n - 1)),
            np.append(total.sum(), np.zeros(n - 1)),
            np.append((total > deleted).sum(), np.zeros(n - 1)),
            np.append((total - deleted).sum(), np.zeros(n - 1)),
        ]
        return pa.table(
            {
                "kind": pa.array([kind] * n, pa.int32()),
                "range": pa.array([where] * n, pa.int32()),
                "block": pa.array(block, pa.int64()),
                "total": pa.array([pack(total[s]) for s in split], pa.binary()),
                "deleted": pa.array([pack(deleted[s]) if b & 1 else None for s, b in zip(split, block)], pa.binary()),
                **{f: pa.array(x.astype(np.int64)) for f, x in zip(("known", "tokens", "main_known", "main_tokens"), figures)},
            }
        )

    schema = "kind int, range int, block bigint, total binary, deleted binary, known bigint, tokens bigint, main_known bigint, main_tokens bigint"
    return asked.groupBy("kind", "range").applyInArrow(run, schema)


def _totals(answer: pa.Table, kind: int, column: str) -> np.ndarray:
    rows = sorted((r["range"], r[column]) for r in answer.to_pylist() if r["kind"] == kind)
    return np.concatenate([unpack(x) for _, x in rows]).astype(np.float64)


def _estimates(block: _Tokens, word: np.ndarray, bigram: np.ndarray, tokens: int) -> tuple[np.ndarray, ...]:
    """Per token: bucket of its context, bigram and word estimates."""
    context, both, own = word[block.context], bigram[block.bigram], word[block.word]
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS), 0)
    return bucket, both / np.maximum(context, 1), own / max(tokens, 1)


def cells(held: DataFrame, answered: DataFrame, tokens: int) -> DataFrame:
    """Held-out counts of the deleted texts, by cell; probabilities as steps, -1 for none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            block = _Tokens(row)
            main = [_totals(right, k, "total") - _totals(right, k, "deleted") for k in (0, 1)]
            bucket, p2, p1 = _estimates(block, *main, tokens)
            steps = [np.where(p > 0, np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64) for p in (p2, p1)]
            found.append(np.stack([bucket, *steps]))
        cell, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True) if found else (np.empty((3, 0), int), np.empty(0, int))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("bucket", "step2", "step1", "n"), (*cell, n))})

    schema = "bucket bigint, step2 bigint, step1 bigint, n bigint"
    odd = "block % 2 = 1"
    pairs = held.where(odd).groupBy("block").cogroup(answered.where(odd).groupBy("block"))
    return pairs.applyInArrow(run, schema).groupBy("bucket", "step2", "step1").agg(F.sum("n").alias("n"))


def learn(cell: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (bucket, 3) of bigram, word and uniform estimates. `cell`: rows of bucket,
    step2, step1, n. A bucket without held-out tokens gets the weights of all together."""
    prob = [np.where(cell[:, i] >= 0, 2.0 ** (-cell[:, i] / STEPS), 0.0) for i in (1, 2)]
    parts = np.stack([*prob, np.full(len(cell), uniform)], axis=1)

    def em(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = rows * weights
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            done = np.abs(new - weights).max() < 1e-9
            weights = new
            if done:
                break
        weights = np.maximum(weights, LEAST_WEIGHT)
        return weights / weights.sum()

    together = em(parts, cell[:, 3]) if len(cell) else np.full(3, 1 / 3)
    out = np.tile(together, (BUCKETS + 1, 1))
    for b in np.unique(cell[:, 0]):
        at = cell[:, 0] == b
        out[b] = em(parts[at], cell[at, 3])
    out[0] = [LEAST_WEIGHT, *(out[0, 1:] / out[0, 1:].sum() * (1 - LEAST_WEIGHT))]  # an unseen context has no bigrams
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (smoothed word
    model) and score (the interpolated model), both log10."""
    spark = docs.sparkSession
    held = written(blocks(docs, id_col, text), "blocks")
    size = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = blocks_for(spark, 8 * size)
    answered = written(answers(requests(held, ranges)), "answers")
    figure = answered.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "tokens", "main_known", "main_tokens")]).first()
    grid = cells(held, answered, figure["main_tokens"]).collect()  # bounded by the grid
    grid = np.array([tuple(r) for r in grid], np.int64).reshape(-1, 4)
    weights = learn(grid, 1 / (figure["main_known"] + 1))
    tokens, known = figure["tokens"], figure["known"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        for row in left.to_pylist():
            block = _Tokens(row)
            word, bigram = (_totals(right, k, "total") for k in (0, 1))
            bucket, p2, p1 = _estimates(block, word, bigram, tokens)
            w = weights[bucket]
            model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (known + 1))
            base = np.log10((word + 0.1) / (tokens + 0.1 * (known + 1)))[block.word]
            add = lambda x: np.add.reduceat(x, block.starts)
            has = np.frombuffer(row["has_id"], bool)
            ids = np.frombuffer(row["ids"], "<i8").tolist()
            values = (
                [i if h else None for i, h in zip(ids, has)],
                (block.folds == HELD_OUT).tolist(),
                block.sizes.tolist(),
                add((word > 0)[block.word].astype(np.int64)).tolist(),
                [tokens] * len(ids),
                add(base).tolist(),
                add(model).tolist(),
            )
            for c, v in zip(columns, values):
                c += v
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return held.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
