"""Vectorised text handling on Arrow string buffers: slices, word and n-gram hashes.

A batch's texts are one byte array with offsets. Words are found and hashed for the whole array at
once; no Python string is made for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Bytes hashed at once; a longer text is cut between words.
BLOCK = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What separates words besides white space, if only letters, digits and characters beyond ASCII count.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    PUNCT[_a : _b + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _table(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        _powers[:] = []
        for base in (_P, _PINV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers


def plain(texts: pa.Array) -> pa.Array:
    """texts as one large_string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets start at 0."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, size: int = SLICE, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows of about `size` bytes; a longer text is alone."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(n, max(at + 1, to), at + (rows or n))
        yield at, to
        at = to


def _hash_block(raw: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of raw; no word crosses a bound (sorted positions)."""
    word = ~sep[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _table(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, sep: np.ndarray = SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts' words, starts, ends, hashes) of a plain() array.

    Words are the runs of bytes that aren't in sep; with lower, A-Z are lower-cased first.
    """
    raw, off = buffers(texts)
    if lower:
        raw = LOWER[raw]
    found, at, n = [], 0, len(raw)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            back = np.flatnonzero(sep[raw[at:to]])
            inside = off[np.searchsorted(off, at, "right") : np.searchsorted(off, to, "right")]
            cuts = [at + int(back[-1]) + 1] if len(back) else []
            cuts += [int(inside[-1])] if len(inside) else []
            if cuts:
                to = max(cuts)
            else:  # one word longer than a block
                end = int(off[np.searchsorted(off, to, "left")])
                hit = np.flatnonzero(sep[raw[to:end]])
                to = to + int(hit[0]) if len(hit) else end
        k0, k1 = np.searchsorted(off, at, "left"), np.searchsorted(off, to, "right")
        s, e, h = _hash_block(raw[at:to], off[k0:k1] - at, sep)
        found.append((s + at, e + at, h))
        at = to
    starts, ends, hashes = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 2 else np.uint64) for k in range(3))
    return raw, np.searchsorted(starts, off), starts, ends, hashes


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each item, the row that it is in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or space."""
    t = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_letters: list[np.ndarray] = []


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased letters as code points, all else as space; offsets of the texts) of a plain() array."""
    if not _letters:
        _letters.append(_letter_table())
    raw, off = buffers(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return _letters[0][points], first[off]
