"""Token ids in files, each document compressed by itself with a shared zstandard dictionary.

A file holds documents in ascending id order. Layout (little-endian):

    magic "ZTOKDOC1", sha-256 of the dictionary (32 bytes), width of an id in bytes (1 byte)
    one zstandard frame per document
    index: n ids (int64), n + 1 frame offsets (int64), n token counts (int64)
    n (int64), offset of the index (int64), magic

The dictionary lies beside the files under its hash. A short document is read by its index
entry alone. The dictionary is trained on whole id arrays of the documents whose hash is least
(at most SAMPLE_DOCS, SAMPLE_BYTES); it only affects compression, and every document is
written. Files get a name of their own per task attempt, and only those in the written list
count, so a lost executor leaves nothing wrong behind.

Defined results: a null or empty text is its end id alone; null ids come first; repeated rows
are written each; extra columns are not read; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, column, file_system, new_path, spread_files, total_bytes, written
from .tokens import Encoder, finished

MAGIC = b"ZTOKDOC1"
DICTIONARY_BYTES = 112_640
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 16 << 20
NO_ID = -(1 << 63)


def _width(encoder: Encoder, end: int) -> np.dtype:
    return np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size() - 1, end) < 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, spaces: str, end: int) -> bytes:
    """Trained in one task on the bounded sample; empty where there is too little text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, samples, size = Encoder.of(tokenizer, spaces), [], 0
        kind = _width(encoder, end)
        for batch in batches:
            for ids in finished(encoder, batch.column(0), end):
                if size + len(ids) * kind.itemsize <= SAMPLE_BYTES:
                    samples.append(ids.astype(kind).tobytes())
                    size += len(samples[-1])
        try:
            data = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few samples for the trainer
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["dictionary"])

    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text")  # only these texts move
    return bytes(max((r["dictionary"] for r in some.coalesce(1).mapInArrow(run, "dictionary binary").collect()), key=len, default=b""))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(
    docs: DataFrame, tokenizer: str, spaces: str = "keep", end: int = 0, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write all documents; the list of files: path, n_docs, n_tokens, first_doc, last_doc, and
    base (tokens in all files before), in ascending order of ids."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    data = train_dictionary(rows, tokenizer, spaces, end)
    digest = hashlib.sha256(data).digest()
    folder = new_path(spark, "tokens")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{digest.hex()}.dictionary") as out:
        out.write(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, spaces)
        kind = _width(encoder, end)
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data))
        fs, path = file_system(folder)
        name, out, at = f"{folder}/part-{uuid.uuid4().hex}.ztok", None, 0
        ids, offsets, counts = [], [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                for doc, tokens in zip(some.column(0).to_pylist(), finished(encoder, some.column(1), end)):
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(file_system(name)[1])
                        at = out.write(MAGIC + digest + bytes([kind.itemsize]))
                    ids.append(NO_ID if doc is None else doc)
                    offsets.append(at)
                    counts.append(len(tokens))
                    at += out.write(packer.compress(tokens.astype(kind).tobytes()))
        if out is not None:
            with out:
                out.write(np.array([*ids, *offsets, at, *counts, len(ids), at], "<i8").tobytes() + MAGIC)
            found = [TaskContext.get().partitionId(), name, len(ids), sum(counts), ids[0], ids[-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in found], ["part", "path", "n_docs", "n_tokens", "first_doc", "last_doc"]
            )

    parts = blocks_for(spark, total_bytes(rows, "text"), 64 << 20)
    files = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(
        run, "part bigint, path string, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint"
    )
    files = written(files, "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written(files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")


class TokenFile:
    """Random access to one file. Reads the header, the index, and what is asked for."""

    def __init__(self, path: str):
        fs, self.path = file_system(path)
        self.file = fs.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n, self.index_at = np.frombuffer(tail[:16], "<i8")
        index = np.frombuffer(self.file.read_at(8 * (3 * n + 1), self.index_at), "<i8")
        self.ids, self.offsets, self.counts = index[:n], index[n : 2 * n + 1], index[2 * n + 1 :]
        self.kind = np.dtype(f"<u{head[-1]}")
        digest = head[len(MAGIC) : -1]
        with fs.open_input_stream(f"{self.path.rpartition('/')[0]}/{digest.hex()}.dictionary") as f:
            data = f.read()
        if hashlib.sha256(data).digest() != digest:
            raise ValueError(f"wrong dictionary beside {path}")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def tokens(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        ids = np.frombuffer(self.unpacker.decompress(frame), self.kind).astype("<u4")
        if len(ids) != self.counts[k]:
            raise ValueError(f"{self.path}: document {k} has {len(ids)} ids, the index says {self.counts[k]}")
        return ids

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document with that id."""
        first, last = np.searchsorted(self.ids, doc_id, "left"), np.searchsorted(self.ids, doc_id, "right")
        return [self.tokens(k) for k in range(first, last)]


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read the files back: doc_id, start (tokens of all documents before), n_tokens, crc32 of
    the ids, and the ids themselves if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = TokenFile(path)
                starts = base + np.cumsum(source.counts) - source.counts
                for i in range(0, len(source.ids), 1000):
                    held = [source.tokens(k) for k in range(i, min(i + 1000, len(source.ids)))]
                    ids = source.ids[i : i + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            pa.array(starts[i : i + 1000], pa.int64()),
                            pa.array(source.counts[i : i + 1000], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in held], pa.int64()),
                            pa.array([x.astype(np.int32) for x in held] if with_ids else [None] * len(held), pa.list_(pa.int32())),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"
    out = spread_files(files.select("path", "base")).mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")
