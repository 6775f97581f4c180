"""Embedding text columns with a model that the user supplies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

_NOT_WORD = r"[^\pL\pN]+"


class Embedder(Protocol):
    """A model: ``make_predict_fn()`` runs once per Python worker and gives a function from
    an array of texts to a (texts x dim) array of floats."""

    dim: int

    def make_predict_fn(self) -> Callable[[np.ndarray], np.ndarray]: ...


class ModelEmbedder:
    """Any model behind a loader that the worker calls once, for example one that opens a
    model file shipped with the job."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int):
        self.load = load
        self.dim = dim

    def make_predict_fn(self):
        encode = self.load()
        return lambda texts: np.asarray(encode([str(t) for t in texts]), dtype=np.float32)


class _WordPlaces(dict):
    """Twice the place of each word, plus one if its sign is positive, kept for a bounded number
    of words."""

    LIMIT = 200_000

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = hashlib.md5(word).digest()
        self[word] = code = int.from_bytes(digest[:4], "big") % self.dim * 2 + (digest[4] < 128)
        return code


class HashEmbedder:
    """Signed feature hashing of words to unit vectors: needs no model, always the same. A batch
    is one scatter: its words are numbered together, each distinct word is looked up once, and signs
    are added up by (text, place)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def make_predict_fn(self):
        dim, codes = self.dim, _WordPlaces(self.dim)

        def places(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            found = words.cast(pa.large_binary()).to_pylist()
            code = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
            return code >> 1, np.where(code & 1, 1.0, -1.0)

        def predict(texts: np.ndarray) -> np.ndarray:
            lowered = pa.array([str(t).lower() for t in texts], pa.large_string())
            split = pc.split_pattern_regex(lowered, _NOT_WORD)
            words = split.flatten()
            text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
            filled = pc.not_equal(words, "")
            coded = words.filter(filled).dictionary_encode()
            text = text[filled.to_numpy(zero_copy_only=False)]
            if not len(text):
                return np.zeros((len(texts), dim), np.float32)
            place, sign = places(coded.dictionary)
            word = coded.indices.to_numpy()
            cells = np.bincount(text * dim + place[word], sign[word], minlength=len(texts) * dim)
            out = cells.reshape(len(texts), dim)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

        return predict


def embed(
    df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch_size: int = 512
) -> DataFrame:
    """Add the vector of a text column. Rows without text get NULL."""
    bound_batches(df.sparkSession)
    model = predict_batch_udf(
        embedder.make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    vector = model(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, F.when(F.col(text).isNotNull(), vector))
