"""Token ids of whole texts from a public tokenizer file, with a bounded memo of pieces.

The tokenizer's rules never join characters across ASCII white space, so a text's ids are those of its words between such
runs, one after the other. A word of Latin letters with marks after it is two pieces, the letters in lower case. Pieces
are found and hashed over whole Arrow columns; each distinct one goes through the library once per worker while the memo
holds it, and ids are gathered by piece.
"""

from __future__ import annotations

import os

import numpy as np

from graphloom.llm.wordhash import word_spans

#: Pieces in the memo of a Python worker (about 100 MB).
MEMO_PIECES = 800_000
#: Marks that the tokenizer keeps together and apart from letters.
MARKS = ".,;:!?*#$%&|()"
#: Splits a joined text into its parts in the library; a piece that has it goes alone.
SEPARATOR = "<|endoftext|>"

_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in MARKS]] = True
_IS_ASCII_LETTER = np.zeros(256, bool)
_IS_ASCII_LETTER[65:91] = _IS_ASCII_LETTER[97:123] = True
#: Second bytes of Latin-1 letters in UTF-8 after 0xC3: all but the signs for times and divided by.
_IS_SECOND = np.zeros(256, bool)
_IS_SECOND[0x80:0xC0] = True
_IS_SECOND[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def letters_and_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Cuts words of letters and marks in two, with A-Z of the letters in lower case. Other words stay as they are."""
    second = np.zeros(len(data), bool)
    second[1:] = _IS_SECOND[data[1:]] & (data[:-1] == 0xC3)
    first = np.zeros(len(data), bool)
    first[:-1] = second[1:]
    others = np.flatnonzero(~(_IS_ASCII_LETTER[data] | first | second))
    stop = np.minimum(np.append(others, len(data))[np.searchsorted(others, starts)], ends)
    marks = np.append(0, np.cumsum(_IS_MARK[data]))
    plain = (stop > starts) & (marks[ends] - marks[stop] == ends - stop)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[plain]] += 1
    edge[stop[plain]] -= 1
    data = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, _LOWER[data], data)
    cut = stop[plain & (stop < ends)]
    return data, np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))


class WordEncoder:
    """encode(column) gives the ids of all texts of a column and where each text's begin."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.refine = letters_and_marks if self._parts_letters() else None
        self._forget()

    def _parts_letters(self) -> bool:
        """Whether the tokenizer lower-cases, and parts letters from marks."""
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        marks = [*MARKS, MARKS, ",;", "!!"]
        return all(one(w + m) == one(w.lower()) + one(m) for w in ("Word", "\xc9t\xe9", "ABC", "\xdf\xff\xc0") for m in marks)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder for this file; a reused worker keeps its memo."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def leave(cls) -> None:
        """Lets go of the memos that a reused worker still holds from packing or encoding."""
        cls._made.clear()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by the library; a call takes many, joined by the separator."""
        out: list = [None] * len(texts)
        joined = [i for i, t in enumerate(texts) if SEPARATOR not in t] if self.separator is not None else []
        for a in range(0, len(joined), 2000):
            part = joined[a : a + 2000]
            ids = np.array(self.tokenizer.encode(SEPARATOR.join(texts[i] for i in part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator)
            for i, x, y in zip(part, np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist(), strict=True):
                out[i] = ids[x:y]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return out

    def _remember(self, keys: list[int], ids: list[np.ndarray]) -> None:
        n, sizes = len(self.slots), np.array([len(x) for x in ids], np.int64)
        while n + len(ids) > len(self.at):
            self.at, self.size = np.append(self.at, np.zeros_like(self.at)), np.append(self.size, np.zeros_like(self.size))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.size[n : n + len(ids)] = sizes
        self.at[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.slots.update(zip(keys, range(n, n + len(ids)), strict=True))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i of a string column has ids first[i] to first[i + 1]; null text has none."""
        hashes, first, data, starts, ends = word_spans(column, refine=self.refine)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slots) + len(keys) > MEMO_PIECES:
            self._forget()
        get = self.slots.get
        slots = np.array([get(k, -1) for k in keys], np.int64)
        if len(new := np.flatnonzero(slots < 0)):
            raw, s, e = data.tobytes(), starts[where[new]].tolist(), ends[where[new]].tolist()
            n = len(self.slots)
            self._remember([keys[i] for i in new.tolist()], self._library([raw[a:b].decode() for a, b in zip(s, e, strict=True)]))
            slots[new] = np.arange(n, n + len(new))
        size, at = self.size[slots][inverse], self.at[slots][inverse]
        before = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return ids, before[first]

    def ids(self, column, dtype: str = "<u4") -> list[bytes]:
        """Each text's ids as little-endian bytes."""
        flat, first = self.encode(column)
        raw, width = flat.astype(dtype).tobytes(), int(dtype[-1])
        edges = (first * width).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def slices(batch, most_bytes: int = 2_000_000, column: str = "text"):
    """Parts of an Arrow batch with at most about `most_bytes` of text each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
