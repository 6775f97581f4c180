"""Hierarchical packing into several context sizes.

A document's whole top-size windows are cut off first; what is left is routed to the smallest
tier that holds it. From the largest tier down, each rest opens a window of its tier, and the
gap is filled from shorter rests: the largest that fits, again and again, and at last a cut one,
so that windows are full and hardly anything is padded. Full windows of a tier are joined to
units of the top size, and units are dealt to step groups so that every group has the same
number of tokens and the same mix of tiers.

Each input partition is packed where it is read, in bounded memory; only its last window can be
padded and only its last step group short. Nothing is shuffled. Ids of sequences and groups hold
the partition number, so a task that is run again gives the same ones.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; extra
columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column
from .tokens import Encoder, finished

TIERS = (256, 512, 1024, 2048)
UNITS_PER_GROUP = 16
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, tier int, step_group bigint, ids array<int>"
)


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:n], self.total),
            Piece(self.doc, self.start + n, self.ids[n:], self.total),
        )


@dataclass
class Packer:
    """Packs one partition. `add` documents, `full` hands out closed step groups, `rest` ends."""

    tiers: tuple[int, ...] = TIERS
    units_per_group: int = UNITS_PER_GROUP
    sizes: list = field(default_factory=list)  # (length, number) of waiting rests, in order
    waiting: dict = field(default_factory=dict)
    number: int = 0
    windows: dict = field(default_factory=dict)  # full windows by tier, not yet in a unit
    units: list = field(default_factory=list)

    def _wait(self, piece: Piece) -> None:
        self.number += 1
        self.waiting[self.number] = piece
        bisect.insort(self.sizes, (len(piece.ids), self.number))

    def _take(self, at: int) -> Piece:
        return self.waiting.pop(self.sizes.pop(at)[1])

    def add(self, doc, ids: np.ndarray) -> None:
        top, whole = self.tiers[-1], Piece(doc, 0, ids, len(ids))
        while len(whole.ids) >= top:
            window, whole = whole.split(top)
            self.units.append((top, [[window]]))
        if len(whole.ids):
            self._wait(whole)

    def close(self) -> None:
        """Close windows while there are shorter rests to fill them from. What is left is
        fewer tokens than one window holds."""
        while self.sizes:
            total = self.sizes[-1][0]
            tier = next(t for t in self.tiers if t >= total)
            window, gap = [self._take(len(self.sizes) - 1)], tier - total
            while gap and self.sizes:
                at = bisect.bisect_right(self.sizes, (gap, self.number)) - 1
                if at >= 0:
                    window.append(self._take(at))
                else:
                    piece, left = self._take(0).split(gap)
                    window.append(piece)
                    self._wait(left)
                gap -= len(window[-1].ids)
            if gap:
                for piece in window:
                    self._wait(piece)
                break
            self._window(tier, window)

    def _window(self, tier: int, window: list[Piece]) -> None:
        held = self.windows.setdefault(tier, [])
        held.append(window)
        if len(held) * tier == self.tiers[-1]:
            self.units.append((tier, self.windows.pop(tier)))

    def full(self) -> list[list]:
        """Closed step groups; units are dealt by tier, so groups have the same mix."""
        count = len(self.units) // self.units_per_group
        if not count:
            return []
        self.units.sort(key=lambda u: -u[0])
        used, self.units = self.units[: count * self.units_per_group], self.units[count * self.units_per_group :]
        return [[(t, w) for t, ws in used[g::count] for w in ws] for g in range(count)]

    def rest(self) -> list[list]:
        """What is left: windows that found no partner, and one that is not full."""
        last = [(t, w) for t, ws in self.units for w in ws] + [(t, w) for t, ws in self.windows.items() for w in ws]
        pieces = [self._take(len(self.sizes) - 1) for _ in range(len(self.sizes))]
        if pieces:
            last.append((self.tiers[-1], pieces))
        self.units, self.windows = [], {}
        return [last] if last else []


def pack(
    docs: DataFrame,
    tokenizer: str,
    spaces: str = "drop",
    end: int = 1,
    tiers: tuple[int, ...] = TIERS,
    units_per_group: int = UNITS_PER_GROUP,
    id_col: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the document, where the piece starts in it, its length, crc32 and (if
    asked for) ids, and its sequence, offset, tier and step group."""
    if any(t & (t - 1) for t in tiers) or sorted(set(tiers)) != list(tiers):
        raise ValueError("tiers are ascending powers of two")

    def rows(groups: list[list], part: int, at: list[int]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(10)]
        for group in groups:
            for tier, window in group:
                offset = 0
                for p in window:
                    crc = zlib.crc32(p.ids.astype("<u4").tobytes())
                    row = (p.doc, p.start, len(p.ids), crc, p.total, (part << 33) + at[0], offset, tier, (part << 33) + at[1])
                    for c, v in zip(columns, (*row, p.ids if with_ids else None)):
                        c.append(v)
                    offset += len(p.ids)
                at[0] += 1
            at[1] += 1
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer, spaces), Packer(tiers, units_per_group)
        part, at = TaskContext.get().partitionId(), [0, 0]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):  # so many documents are held at a time
                some = batch.slice(i, 1000)
                for doc, ids in zip(some.column(0).to_pylist(), finished(encoder, some.column(1), end)):
                    packer.add(doc, ids)
                packer.close()
                if groups := packer.full():
                    yield rows(groups, part, at)
        if groups := packer.rest():
            yield rows(groups, part, at)

    out = docs.select(column(docs, id_col).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
