"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

Words are the runs of bytes other than space and TAB to CR. A word's hash is a polynomial over random byte values, taken
from prefix sums, then mixed; hashes of runs of words are taken from prefix sums over word hashes in the same way.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R, _C = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; grown tables are kept."""
    size = 1 << max(n - 1, 1).bit_length()
    got = next((t for (b, s), t in _powers.items() if b == base and s >= size), None)
    if got is None:
        got = np.full(size, base & (2**64 - 1), np.uint64)
        got[0] = 1
        got = np.cumprod(got)
        if size <= 1 << 22:
            _powers[base, size] = got
    return got[:n]


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(z: np.ndarray, seed: int = 0) -> np.ndarray:
    z = z + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of `data`; `breaks` are positions at which a word ends in any case."""
    word = ~_IS_SPACE[data]
    before = np.empty(len(word), bool)
    before[0], before[1:] = False, word[:-1]
    before[breaks] = False
    after = np.empty(len(word), bool)
    after[-1], after[:-1] = False, word[1:]
    after[breaks[breaks > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_R, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(_R), len(data) + 1)[starts])


def words_of(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words of all texts of a string column in order; text i has words first[i] to first[i + 1].
    `lower` takes A-Z as a-z."""
    hashes, first, _, _, _ = word_spans(column, lower)
    return hashes, first


def word_spans(column, lower: bool = False, refine=None):
    """(hashes, first, data, starts, ends): words_of, with the texts' bytes and each word's place in them. `refine` may
    cut words into pieces and change their bytes, block by block: (data, starts, ends) to the same."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:  # a null's bytes, if it has any, aren't text
        column = column.fill_null("")
    none = np.zeros(0, np.int64)
    nothing = np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8), none, none
    if len(column) == 0:
        return nothing
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    base, end = int(offsets[0]), int(offsets[-1])
    if end == base:
        return nothing
    data = np.frombuffer(column.buffers()[2], np.uint8, end - base, base)
    data = _LOWER[data] if lower else data
    edges = offsets - base
    parts, changed, at = [], [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not _IS_SPACE[data[stop]]:  # blocks end at white space, or where a text ends
            window = data[stop : stop + 4096]
            space = np.flatnonzero(_IS_SPACE[window])
            edge = int(edges[np.searchsorted(edges, stop)])
            stop = min(stop + (int(space[0]) if len(space) else len(window)), edge)
            if stop == edge:
                break
        block = data[at:stop]
        s, e = _spans(block, edges[(edges >= at) & (edges < stop)] - at)
        if refine:
            block, s, e = refine(block, s, e)
            changed.append(block)
        parts.append((_hashes(block, s, e), s + at, e + at))
        at = stop
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(starts, edges), np.concatenate(changed) if refine else data, starts, ends


class Runs:
    """Hashes of runs of words [start, end) of one list of word hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_C, len(words)), out=self.sums[1:])
        self.back = powers(inverse(_C), len(words) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64), seed)
