"""Ranked search by words: one automaton of all items' terms runs over the texts.

A term is a run of letters, digits and anything beyond ASCII, A-Z lower-cased. Texts become bytes
in which whatever separates terms is a space, and each pattern of the Aho-Corasick automaton is a
term between spaces, so that only whole terms match. A document's term counts come straight from
the scan; nothing is stored by document. The automaton's outputs are term numbers, and a table maps
each to the items that hold it.

Two scans: the first adds up the corpus counts (documents, terms, documents by term; one row per
term and task), the second scores each document for the items it shares a term with and keeps a
task's best rows per item. Only these are shuffled, and ranked in two steps.

All tasks hold the automaton. Its terms have at most AUTOMATON_BYTES: where the items' texts are
larger, items are dealt to several automata, each with scans of its own. An item must fit alone.

Scores are those of a term's weight w = floor(1000 ln((2N+2)/(2df+1))) and of integers: with
m = 50 + (50 n N) div L, the sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms.

Defined results: null texts have no terms; null item ids and items without terms give no rows;
rows that share an item id are one item; documents with a null id count, but are not ranked;
repeated documents count and are ranked each; ties go to the smaller doc_id; extra columns are
not read; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import rank_hits
from .common import column, total_bytes, written

AUTOMATON_BYTES = 2 << 20
#: Scores and matches that a task holds at once.
CELLS = 4 << 20
DOCS_AT_ONCE = 1_000

#: Bytes of a text: lower-case ASCII letters, digits and anything beyond ASCII stay, A-Z become
#: a-z, all others a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def folded(text: str | None) -> bytes:
    return b" " + (text or "").encode().translate(_FOLD) + b" "


class TermScan:
    """An automaton over whole terms. Bytes are matched as characters of the same number."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word((b" " + term + b" ").decode("latin-1"), number)
        self.size = len(terms)
        if terms:
            self.automaton.make_automaton()

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text; then text, term and tf of each match of a text and a term."""
        lengths = np.zeros(len(texts), np.int64)
        parts = []
        for i, text in enumerate(texts):
            data = folded(text)
            filled = np.frombuffer(data, np.uint8) != 32
            lengths[i] = np.count_nonzero(filled[1:] > filled[:-1])
            if lengths[i] and self.size:
                found = np.fromiter(map(itemgetter(1), self.automaton.iter(data.decode("latin-1"))), np.int64)
                parts.append(_tally(found + i * self.size))
        key, tf = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
        return lengths, key // max(1, self.size), key % max(1, self.size), tf


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def corpus_counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents by term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held = TermScan(terms), np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for some in _slices(batch, DOCS_AT_ONCE):
                lengths, _, term, _ = scan.counts(some.column(0).to_pylist())
                held[:-2] += np.bincount(term, minlength=len(terms))
                held[-2:] += np.count_nonzero(lengths), lengths.sum()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 2, np.int64)
    for row in found.collect():  # a row per term at most
        out[row.term] = row.n
    return int(out[-2]), int(out[-1]), out[:-2]


class _Best:
    """A task's k best documents of each item; rows that tie with the k-th stay until the id decides."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.count, self.limit = 0, max(1 << 16, 4 * items * k)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.floor))
        self.rows.append((item, scores[doc, item], ids[doc]))
        self.count += len(doc)
        if self.count > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        item, score, ids = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = place < self.k
        last = place == self.k - 1
        self.floor[item[last]] = score[last]
        self.rows = [(item[keep], score[keep], ids[keep])]
        self.count = int(keep.sum())
        return self.rows[0]


def best_documents(
    docs: DataFrame, item_ids: list[int], terms: list[bytes], links: tuple[np.ndarray, np.ndarray], k: int
) -> DataFrame:
    """item_id, doc_id, score: a task's k best documents of each item. ``links`` are pairs of term
    and item numbers, by term."""
    n_docs, n_terms, df = corpus_counts(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    begin = np.searchsorted(links[0], np.arange(len(terms) + 1))
    names, holders = np.array(item_ids, np.int64), links[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, best = TermScan(terms), _Best(len(names), k)
        size = max(1, min(DOCS_AT_ONCE, CELLS // len(names)))
        for batch in batches:
            for some in _slices(batch, size):
                lengths, doc, term, tf = scan.counts(some.column(1).to_pylist())
                m = np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], np.int64) if n_terms else lengths
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                held = begin[term + 1] - begin[term]
                entry = np.arange(held.sum()) + np.repeat(begin[term] - (np.cumsum(held) - held), held)
                scores = np.zeros(len(lengths) * len(names), np.int64)
                np.add.at(scores, np.repeat(doc, held) * len(names) + holders[entry], np.repeat(value, held))
                known = some.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = some.column(0).fill_null(0).to_numpy()
                best.offer(scores.reshape(len(lengths), len(names))[known], ids[known])
        if best.rows:
            item, score, ids = best.prune()
            table = pa.table({"item_id": pa.array(names[item]), "doc_id": pa.array(ids), "score": pa.array(score)})
            yield from table.to_batches(max_chunksize=65_536)

    return docs.select("doc_id", "text").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def _terms_of(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(folded(text).split(b" ")) - {b""}
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    return items.mapInArrow(run, "item_id bigint, term binary").distinct()


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    asked = items.select(column(items, item_col).cast("bigint").alias("item_id"), column(items, item_text).cast("string").alias("text"))
    asked = asked.where("item_id is not null")
    automata = max(1, -(-total_bytes(asked, "text") // automaton_bytes))
    pairs = _terms_of(asked)
    hits = None
    for number in range(automata):
        mine = pairs if automata == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(automata)) == number)
        held = mine.toArrow()  # about automaton_bytes at most
        if not len(held):
            continue
        terms, term = np.unique(np.array(held.column("term").to_pylist(), object), return_inverse=True)
        names, item = np.unique(held.column("item_id").to_numpy(), return_inverse=True)
        order = np.argsort(term, kind="stable")
        found = best_documents(rows, names.tolist(), list(terms), (term[order], item[order]), k)
        hits = written(found, "hits") if hits is None else hits.unionByName(written(found, "hits"))
    if hits is None:
        hits = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    return rank_hits(hits, k, query="item_id", ties=("doc_id",)).select("item_id", "rank", "doc_id", "score")
