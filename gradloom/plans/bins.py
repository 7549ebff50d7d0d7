"""Rows of bins and raw values as tasks hold them: dense ones as arrays, sparse ones as sorted (row, cell) keys.

Both kinds answer rows[numbers of rows, numbers of features] and len(), which is all that routing through trees needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gradloom.plans.kernel import MISSING, Cuts, partial_histogram

#: Cells that sparse sums hold before they are added up.
HELD = 1 << 21


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column without nulls."""
    off = column.offsets.to_numpy()
    return off - off[0], column.flatten().to_numpy(zero_copy_only=False)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary."""
    raw = np.ascontiguousarray(rows)
    off = np.arange(len(raw) + 1, dtype=np.int32) * (raw.itemsize * raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def unpacked(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """packed() rows, column by column in memory."""
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return np.asfortranarray(raw.view(kind).reshape(len(column), width))


class Sparse:
    """Rows of (feature, number) cells, ascending by feature; number is a bin or a value, `none` where a row has no such cell."""

    def __init__(self, off: np.ndarray, features: np.ndarray, numbers: np.ndarray, width: int, none: float) -> None:
        self.rows, self.width, self.none, self.numbers = len(off) - 1, width, none, numbers
        self.owner = np.repeat(np.arange(self.rows), np.diff(off))
        self.features = features.astype(np.int64)
        self.keys = self.owner * width + self.features

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        key = np.asarray(at[0], np.int64) * self.width + at[1]
        if not len(self.keys):
            return np.full(len(key), self.none, self.numbers.dtype)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.numbers[place], self.none)


def deduplicated(off: np.ndarray, features: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells sorted by feature within rows, without NaN; of repeated ones the first counts."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys, first = np.unique(owner * width + features.astype(np.int64), return_index=True)
    live = ~np.isnan(values[first])
    keys, first = keys[live], first[live]
    return np.searchsorted(keys, np.arange(len(off)) * width), keys % width, values[first].astype(np.float32)


def sparse_bins(features: np.ndarray, values: np.ndarray, cuts: Cuts) -> np.ndarray:
    """The local bins of cells."""
    out = np.zeros(len(values), np.int32)
    order = np.argsort(features, kind="stable")
    own, start = np.unique(features[order], return_index=True)
    for f, a, b in zip(own.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        at = order[a:b]
        out[at] = Cuts([cuts.cuts[f]], frozenset({0} if f in cuts.categorical else ()), cuts.exact).bins(values[at][:, None])[:, 0]
    return out


class Sums:
    """Sums of g, h and rows by (slot, global bin), and of each slot; dense where there are few such cells, else lists that are added up now and then."""

    def __init__(self, slots: int, sizes: np.ndarray, dense: bool) -> None:
        self.slots, self.sizes, self.base = slots, sizes, np.append(0, np.cumsum(sizes))
        self.width = int(self.base[-1])
        self.rows = 0
        self.total = np.zeros((slots, 3))
        self.dense = np.zeros((slots, 3, self.width + 1)) if dense else None
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, bins: np.ndarray | Sparse, live: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, times: np.ndarray | None = None) -> None:
        """The rows `live`, which are in slots `slot`; times: how many rows each stands for."""
        self.rows += len(live)
        if self.dense is not None and not isinstance(bins, Sparse):
            self.dense += partial_histogram(bins, live, slot, g, h, self.slots, self.sizes, times)
            return
        for c, w in ((0, g[live]), (1, h[live]), (2, None if times is None else times[live])):
            self.total[:, c] += np.bincount(slot, w, self.slots)
        if isinstance(bins, Sparse):
            of = np.full(len(g), -1)
            of[live] = slot
            at = of[bins.owner]
            use = at >= 0
            key, row = at[use] * self.width + self.base[bins.features[use]] + bins.numbers[use], bins.owner[use]
        else:
            own = bins[live]
            row, f = np.nonzero(own != MISSING)
            key, row = slot[row] * self.width + self.base[f] + own[row, f], live[row]
        values = g[row], h[row], np.ones(len(row)) if times is None else times[row]
        if self.dense is None:
            self._hold(key, *values)
            return
        for c, v in enumerate(values):
            self.dense[:, c, :-1] += np.bincount(key, v, self.slots * self.width).reshape(self.slots, -1)
            self.dense[:, c, -1] = self.total[:, c]

    def _hold(self, key: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((key, *values))
        self.held += len(key)
        if self.held > HELD:
            self._compact()

    def _compact(self) -> None:
        key = np.concatenate([p[0] for p in self.parts])
        key, back = np.unique(key, return_inverse=True)
        self.parts = [(key, *[np.bincount(back, np.concatenate([p[c] for p in self.parts]), len(key)) for c in (1, 2, 3)])]
        self.held = max(0, len(key) - HELD // 2)  # grow before the next time, so that this stays in proportion

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot * width + global bin, ascending; their three sums)."""
        if self.dense is not None:
            self.total = self.dense[:, :, -1]
            at = self.dense[:, 2, :-1].ravel().nonzero()[0]
            return at, self.dense[:, :, :-1].transpose(1, 0, 2).reshape(3, -1)[:, at]
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros((3, 0))
        self._compact()
        return self.parts[0][0], np.stack(self.parts[0][1:])
