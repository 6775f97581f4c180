"""Token ids by a public tokenizer, encoded piece by piece with a bounded memory of pieces.

The pre-tokenizers in use never join characters across the places where a text is cut here, so
the ids of a text are those of its pieces in order; equal pieces are encoded once. Texts are cut
by their bytes, and their distinct pieces found by Arrow, in groups of texts.

`drop`: the tokenizer drops white space; cut at ASCII white space.
`keep`: byte-level pre-tokenizer; a space belongs to the word after it, so cut before a single
space between other characters.

Where the tokenizer's file holds a pre-tokenizer of `KNOWN`, texts are cut into runs of letters,
digits and signs too, as that one does, and at all ASCII white space that it parts. Runs of Latin
letters are then what its BPE model takes, and go to the model alone. Any other piece, and a text
that holds an added token, goes through the whole tokenizer.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many distinct pieces are remembered by a worker; then the less used half is forgotten.
PIECES = 400_000
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 4_000_000

#: What a byte belongs to. LETTER: A-Z, a-z and the letters of U+00C0 to U+00FF, which no normal form
#: changes. UNSURE: white space beyond ASCII and control characters; nothing is cut beside these.
SPACE, LINE, LETTER, DIGIT, SIGN, QUOTE, OTHER, UNSURE = range(8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[:128] = SIGN
CLASS[:32], CLASS[127] = UNSURE, UNSURE
CLASS[9:14], CLASS[32], CLASS[39] = LINE, SPACE, QUOTE
CLASS[48:58], CLASS[65:91], CLASS[97:123] = DIGIT, LETTER, LETTER
#: Cut between two bytes of these classes; a quote may begin "'s" or end a run of signs.
RUNS = np.zeros((8, 8), bool)
RUNS[LETTER, [DIGIT, SIGN, QUOTE]] = RUNS[DIGIT, [LETTER, SIGN, QUOTE]] = True
RUNS[SIGN, [LETTER, DIGIT]] = RUNS[QUOTE, DIGIT] = True
#: First bytes of white space beyond ASCII.
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")

BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d|"
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": CONTRACTED + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
FORMS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Normalizers and pre-tokenizers, but for offsets, that part runs of letters, digits and signs.
KNOWN = {
    "drop": (
        {"type": "Sequence", "normalizers": FORMS},
        {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL | {"use_regex": False}]},
    ),
    "keep": (None, BYTE_LEVEL),
}


def _byte_letters() -> str:
    """The characters that stand for the bytes 0 to 255 in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


BYTE_LETTERS = _byte_letters()
JOINED_LETTERS = BYTE_LETTERS[:10] + "\n" + BYTE_LETTERS[11:]


def _without_offsets(part):
    if isinstance(part, dict):
        return {k: _without_offsets(v) for k, v in part.items() if k != "trim_offsets"}
    return [_without_offsets(v) for v in part] if isinstance(part, list) else part


def _widths(config: dict, spaces: str) -> np.ndarray | None:
    """How many bytes each id of the model stands for; None where runs are not known to be cut as
    this tokenizer does, or the model does not merge plain bytes."""
    model, added = config["model"], config["added_tokens"]
    if (_without_offsets(config["normalizer"]), _without_offsets(config["pre_tokenizer"])) != KNOWN[spaces]:
        return None
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    if any(LETTERS.fullmatch(t["content"]) for t in added):  # a piece would hide it
        return None
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    if not all(c + s in vocab for c in BYTE_LETTERS for s in {"", suffix}):
        return None
    widths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        widths[i] = len(token.removesuffix(suffix))
    return widths


class Encoder:
    _held: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, path: str, spaces: str) -> Encoder:
        """One for each tokenizer and worker process."""
        if (path, spaces) not in cls._held:
            cls._held[path, spaces] = cls(path, spaces)
        return cls._held[path, spaces]

    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.keep = {"drop": False, "keep": True}[spaces]
        self.widths = _widths(config, spaces)
        self.added = [t["content"] for t in config["added_tokens"]]
        self.lower = self.widths is not None and config["normalizer"] is not None
        self.model = Tokenizer(self.tokenizer.model)
        self.index: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _coarse(self, texts: pa.Array) -> np.ndarray:
        """Which texts are cut at white space alone."""
        if self.widths is None:
            return np.ones(len(texts), bool)
        found = np.zeros(len(texts), bool)
        for token in self.added:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    @staticmethod
    def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each byte, and where second bytes of letters beyond ASCII are."""
        kind = CLASS[data]
        second = np.flatnonzero(data == 0xC3) + 1
        second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
        kind[second - 1] = kind[second] = LETTER
        first = np.flatnonzero(WIDE[data])
        if len(first):
            size = np.where(data[first] == 0xC2, 2, 3)
            code = (data[first].astype(np.int64) << 16) | (data[first + 1].astype(np.int64) << 8)
            code |= np.where(size == 3, data[np.minimum(first + 2, len(data) - 1)], 0)
            seen, at = np.unique(code, return_inverse=True)
            wide = [c.to_bytes(3).removesuffix(b"\0").decode().isspace() for c in seen.tolist()]
            odd = np.array(wide)[at]
            for k in range(3):
                kind[first[odd & (size > k)] + k] = UNSURE
        return kind, second

    def _cuts(self, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """Where pieces begin, given where the texts that are not empty begin and end."""
        white, solid = kind <= LINE, (kind >= LETTER) & (kind <= OTHER)
        before, after = kind[:-1], kind[1:]
        cut = np.zeros(len(kind), bool)
        cut[1:] = RUNS.ravel()[(before << 3) | after]
        if self.keep:
            then = np.append(solid[1:], False)  # something solid follows in the text
            then[ends - 1] = False
            sure = np.append(True, kind[:-1] != UNSURE)  # nothing unsure precedes in the text
            sure[starts] = True
            cut[1:] |= white[1:] & (solid[:-1] | (white[:-1] & then[1:]))
            cut[1:] |= (before == LINE) & sure[:-1] & solid[1:]
            plain = np.append(False, solid[:-1]) & (kind == SPACE) & then
        else:
            plain = np.append(True, white[1:] != white[:-1])
            cut |= plain
        if coarse.any():
            cut &= plain | np.repeat(~coarse, ends - starts)
        cut[starts] = True
        return np.flatnonzero(cut)

    @staticmethod
    def _lowered(data: np.ndarray, kind: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pieces that are Latin letters alone in lower case; others may hold marks or added tokens."""
        low = np.repeat(np.maximum.reduceat(kind, at) == LETTER, np.diff(at, append=len(data)))
        upper = np.flatnonzero((data - np.uint8(65)) < 26)
        second = second[data[second] <= 0x9E]
        data = data.copy()
        for some in (upper, second):
            data[some[low[some]]] += 32
        return data

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and how many each has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        filled = offsets[1:] > offsets[:-1]
        kind, second = self._classes(data)
        coarse = self._coarse(texts)
        at = self._cuts(kind, offsets[:-1][filled], offsets[1:][filled], coarse[filled])
        if self.lower:
            data = self._lowered(data, kind, second, at)
        size = np.diff(at, append=len(data))
        if not self.keep:
            at, size = at[kind[at] > LINE], size[kind[at] > LINE]
            data = data[kind > LINE]
        buffers = [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), buffers), np.diff(np.searchsorted(at, offsets))

    def _grow(self, name: str, size: int) -> None:
        held = getattr(self, name)
        if size > len(held):
            setattr(self, name, np.resize(held, max(size, 2 * len(held))))

    def _whole(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has, by the whole tokenizer. Pieces are words of one
        input, so that there is one result for all of them."""
        found = self.tokenizer.encode([p.decode() for p in part], is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))

    def _letters(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, by the model alone; the widths of ids tell words apart."""
        words = codecs.charmap_decode(b"\n".join(part), "strict", JOINED_LETTERS)[0].split("\n")
        found = self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in part])) + 1
        return ids, np.diff(ends, prepend=0)

    def _plain(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are runs of letters, in `keep` with a space before them or not."""
        if self.widths is None:
            return np.zeros(len(pieces), bool)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
        kind, _ = self._classes(np.frombuffer(pieces.buffers()[2], np.uint8)[: offsets[-1]])
        other = kind != LETTER
        other[offsets[:-1]] &= kind[offsets[:-1]] != SPACE
        return ~np.logical_or.reduceat(other, offsets[:-1]) & (kind[offsets[1:] - 1] == LETTER)

    def _learn(self, letters: list[bytes], others: list[bytes]) -> None:
        for new, by in ((letters, self._letters), (others, self._whole)):
            for i in range(0, len(new), 5_000):
                part = new[i : i + 5_000]
                ids, count = by(part)
                k = len(self.index)
                for name in ("start", "count", "uses"):
                    self._grow(name, k + len(part))
                self._grow("ids", self.used + len(ids))
                self.ids[self.used : self.used + len(ids)] = ids
                self.count[k : k + len(part)], self.uses[k : k + len(part)] = count, 0
                self.start[k : k + len(part)] = self.used + np.cumsum(count) - count
                self.used += len(ids)
                self.index.update(zip(part, range(k, k + len(part))))

    def _ids_of(self, at: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        count = self.count[at]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def _forget(self) -> None:
        n = len(self.index)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: PIECES // 2])
        names = list(self.index)
        ids, count = self._ids_of(keep), self.count[keep]
        self.index = {names[k]: i for i, k in enumerate(keep)}
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.uses[: len(keep)] = self.uses[keep] // 2
        self.count[: len(keep)], self.start[: len(keep)] = count, np.cumsum(count) - count

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """One array of ids (uint32) for each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        pieces, counts = self._split(texts)
        if not len(pieces):
            return [np.empty(0, np.uint32) for _ in range(len(texts))]
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > PIECES:
            self._forget()
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        plain = self._plain(coded.dictionary)
        new = [np.flatnonzero((place < 0) & which) for which in (plain, ~plain)]
        place[np.concatenate(new)] = len(self.index) + np.arange(len(new[0]) + len(new[1]))
        self._learn(*([words[i] for i in some.tolist()] for some in new))
        number = coded.indices.to_numpy()
        self.uses[place] += np.bincount(number, minlength=len(words))
        at = place[number]
        ids = self._ids_of(at)
        ends = np.append(0, np.cumsum(self.count[at]))
        return np.split(ids, ends[np.cumsum(counts)[:-1]])


def finished(encoder: Encoder, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
    """Ids of each text (none of a null), in order, with an end id after them; encoded in groups of
    bounded size."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts.validate(full=True)  # bytes that are not UTF-8 are refused
    group = pc.binary_length(texts).to_numpy().cumsum() // GROUP_BYTES
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for first, last in zip(starts, [*starts[1:], len(texts)]):
        for ids in encoder.encode(texts.slice(first, last - first)):
            yield np.append(ids, np.uint32(end))
