"""The numpy side of training: trees as arrays, histograms, split search, growth. No Spark in here.

The same code runs inside one task, over all rows of a small table, and on the driver over histograms that Spark has summed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from gradloom.functions.gain import EPS, np_score, np_score_at, np_weight
from gradloom.operators.trees import allowed_features
from gradloom.params import TrainingParams

MISSING = -1


@dataclass
class Tree:
    """Nodes as lists; a leaf has left -1. categories is None for numeric splits; bin is the last bin that goes left."""

    feature: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    default_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    hess: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    categories: list[list[int] | None] = field(default_factory=lambda: [None])
    bin: list[int] = field(default_factory=lambda: [0])
    left_bins: list[list[int] | None] = field(default_factory=lambda: [None])

    def __len__(self) -> int:
        return len(self.feature)

    def split(self, node: int, feature: int, threshold: float, default_left: bool, gain: float, bin_: int, categories: list[int] | None = None, left_bins: list[int] | None = None) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.default_left[node], self.gain[node], self.bin[node] = feature, threshold, default_left, gain, bin_
        self.categories[node], self.left_bins[node] = categories, left_bins
        ids = []
        for _ in range(2):
            ids.append(len(self.feature))
            for name, v in (("feature", 0), ("threshold", 0.0), ("default_left", False), ("left", -1), ("right", -1), ("value", 0.0), ("hess", 0.0), ("gain", 0.0), ("categories", None), ("bin", 0), ("left_bins", None)):
                getattr(self, name).append(v)
        self.left[node], self.right[node] = ids
        return ids[0], ids[1]

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: np.array(getattr(self, n)) for n in ("feature", "threshold", "default_left", "left", "right", "value", "bin")}

    def advance(self, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Where rows at these nodes end up, by their local bins (rows x features)."""
        a = self.arrays()
        cats = any(c is not None for c in self.left_bins)
        node = node.copy()
        live = np.flatnonzero(a["left"][node] >= 0)
        while len(live):
            at = node[live]
            b = bins[live, a["feature"][at]]
            left = b <= a["bin"][at]
            if cats:
                for k in np.unique(at):
                    if self.left_bins[k] is not None:
                        own = at == k
                        left[own] = np.isin(b[own], self.left_bins[k])
            left = np.where(b == MISSING, a["default_left"][at], left)
            node[live] = np.where(left, a["left"][at], a["right"][at])
            live = live[a["left"][node[live]] >= 0]
        return node

    def sides(self, node: int, rows: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a split node that go left, and those that go right."""
        b = bins[:, self.feature[node]].take(rows)
        left = b <= self.bin[node] if self.left_bins[node] is None else np.isin(b, self.left_bins[node])
        if (miss := b == MISSING).any():
            left = np.where(miss, self.default_left[node], left)
        return rows[left], rows[~left]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of raw features, NaN where missing."""
        a = self.arrays()
        threshold = a["threshold"].astype(np.float32)
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(a["left"][node] >= 0)
        while len(live):
            at = node[live]
            v = x[live, a["feature"][at]]
            left = v < threshold[at]
            for k in np.unique(at):
                if self.categories[k] is not None:
                    own = at == k
                    left[own] = np.isin(np.maximum(np.nan_to_num(v[own]), 0).astype(np.int64), self.categories[k])
            left = np.where(np.isnan(v), a["default_left"][at], left)
            node[live] = np.where(left, a["left"][at], a["right"][at])
            live = live[a["left"][node[live]] >= 0]
        return node


class Ragged:
    """A list of arrays kept as one, so that millions of short ones are stored and sent quickly."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.values, self.offsets = values, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, at: int | slice) -> np.ndarray | Ragged:
        if isinstance(at, slice):
            a, b, _ = at.indices(len(self))
            return Ragged(self.values[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])
        return self.values[self.offsets[at] : self.offsets[at + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self)))


@dataclass
class Cuts:
    """cuts[f]: ascending; exact: the values themselves, split halfway between those present; categorical features by equality."""

    cuts: list[np.ndarray] | Ragged
    categorical: frozenset[int] = frozenset()
    exact: bool = False

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.cuts.offsets) if isinstance(self.cuts, Ragged) else np.array([len(c) for c in self.cuts])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Local bins of raw features (rows x features, column by column in memory), MISSING for NaN."""
        out = np.empty(x.shape, np.int16 if self.sizes.max(initial=1) < 1 << 15 else np.int32, "F")
        for f, c in enumerate(self.cuts):
            v = x[:, f]
            if f in self.categorical:
                at = np.minimum(np.searchsorted(c, v), len(c) - 1)
                b = np.where(c[at] == v, at, 0)
            elif self.exact:
                b = np.clip(np.searchsorted(c, v, "right") - 1, 0, len(c) - 1)
            else:
                b = np.minimum(np.searchsorted(c, v, "right"), len(c) - 1)
            out[:, f] = np.where(np.isnan(v), MISSING, b)
        return out


def make_cuts(x: np.ndarray, max_bin: int, categorical: frozenset[int], exact: bool = False, hess: np.ndarray | None = None, times: np.ndarray | None = None) -> Cuts:
    """Cuts of raw features, by the rules of operators.binning; times: how many rows each row stands for."""
    out = []
    for f in range(x.shape[1]):
        v = x[:, f]
        ok = ~np.isnan(v)
        values, inverse, n = np.unique(v[ok], return_inverse=True, return_counts=True)
        values = values.astype(np.float32)
        if times is not None:
            n = np.bincount(inverse, times[ok], len(values))
        if not len(values):
            out.append(np.zeros(1, np.float32))
        elif f in categorical or exact:
            out.append(values)
        else:
            if len(values) > max_bin:
                upto = np.cumsum(n)
                if hess is not None and (total := float((hs := np.bincount(inverse, hess[ok])).sum())) > 0:
                    run = np.cumsum(hs)
                    goal = np.arange(1, max_bin) * total / max_bin
                    at = np.minimum(np.searchsorted(run + 1e-12, goal), len(values) - 1)
                else:
                    rank = np.maximum(np.ceil(np.arange(1, max_bin) / max_bin * upto[-1]), 1)
                    at = np.searchsorted(upto, rank)
                values, top = values[np.unique(at)], values[-1]
            else:
                top = values[-1]
            out.append(np.append(values, np.nextafter(top, np.float32(np.inf), dtype=np.float32)))
    return Cuts(out, categorical, exact)


def partial_histogram(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, sizes: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """(slots, 3, sum of sizes + 1): sums of g, h and 1 (or times) over rows, by their slot and global bin; the last bin holds each slot's totals."""
    base = np.append(0, np.cumsum(sizes))
    out = np.zeros((slots, 3, int(base[-1]) + 1))
    if not len(rows):
        return out
    everyone = len(rows) == len(bins) and (rows[1:] > rows[:-1]).all()
    s, gr, hr = slot.astype(np.int64), g[rows], h[rows]
    nr = None if times is None else times[rows]
    constant = hr[0] if nr is None and hr.max() == hr.min() else None
    first = {n: s * n for n in set(sizes.tolist())}  # where each row's slot begins in a histogram of n bins
    for f, n in enumerate(sizes.tolist()):
        b = bins[:, f] if everyone else bins[:, f].take(rows)
        key, gf, hf, nf = first[n] + b, gr, hr, nr
        if b.min() == MISSING:
            use = b != MISSING
            key, gf, hf, nf = key[use], gr[use], hr[use], None if nr is None else nr[use]
        at = slice(base[f], base[f + 1])
        count = np.bincount(key, nf, minlength=slots * n).reshape(slots, n)
        out[:, 0, at] = np.bincount(key, gf, minlength=slots * n).reshape(slots, n)
        out[:, 1, at] = count * constant if constant is not None else np.bincount(key, hf, minlength=slots * n).reshape(slots, n)
        out[:, 2, at] = count
    for c, w in ((0, gr), (1, hr), (2, nr)):
        out[:, c, -1] = np.bincount(s, w, minlength=slots)
    return out


@dataclass
class Split:
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    threshold: float = 0.0
    default_left: bool = False
    categories: list[int] | None = None
    left_bins: list[int] | None = None
    left: tuple[float, float] = (0.0, 0.0)
    right: tuple[float, float] = (0.0, 0.0)


#: Cells of histograms searched at once.
CELLS = 1 << 16


class Searcher:
    """Finds nodes' best splits in their histograms."""

    def __init__(self, cuts: Cuts, p: TrainingParams) -> None:
        """Parameters are for these cuts' features; with constraints on features elsewhere, weights are bounded here too."""
        self.cuts, self.p, self.n = cuts, p, len(cuts.cuts)
        self.base = np.append(0, np.cumsum(cuts.sizes))
        self.width = int(cuts.sizes.max())
        self.even = bool((cuts.sizes == self.width).all())
        sizes = cuts.sizes
        self.pad = np.arange(self.width)[None] >= sizes[:, None]
        self.index = np.where(self.pad, -1, self.base[:-1, None] + np.arange(self.width)[None])
        self.numeric = np.ones(self.n, bool)
        self.numeric[list(cuts.categorical)] = False
        self.inner = (np.arange(self.width)[None] < (sizes - 1)[:, None]) & self.numeric[:, None]
        c = list(p.monotone_constraints) + [0] * self.n
        self.direction = np.array(c[: self.n])
        self.bounded = bool(self.direction.any())

    def best(self, hists: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Split]:
        """The best split of each node: hists (nodes, 3, global bins + totals), features allowed (nodes, features), bounds of weights."""
        step = max(1, CELLS // (self.n * self.width))
        parts = [slice(a, a + step) for a in range(0, len(hists), step)]
        return [x for at in parts for x in self._best(hists[at], features[at], low[at], high[at])]

    def _numeric(self, hists: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray):  # noqa: ANN202
        """(gain of each node's candidates: features, bins, ways; the split at one of them)."""
        total = hists[:, :, -1]
        cells = hists[:, :, :-1].reshape(len(hists), 3, self.n, self.width) if self.even else np.where(self.pad, 0.0, hists[:, :, self.index])
        run = np.cumsum(cells, axis=3)
        missing = total[:, :, None] - run[:, :, :, -1]  # (nodes, 3, features)
        # where rows may lack a feature, they go right in the first way and left in the second
        ways = 2 if (missing[:, 2] > 0).any() or (missing[:, 1] > 1e-6).any() else 1
        left = [run[:, c, :, :, None] if ways == 1 else np.stack([run[:, c], run[:, c] + missing[:, c, :, None]], 3) for c in range(2)]
        gl, hl = left
        gt, ht = (total[:, c, None, None, None] for c in range(2))
        gr, hr = gt - gl, ht - hl
        ok = np.repeat((self.inner[None] & features[:, :, None])[..., None], ways, 3)
        if self.cuts.exact:
            ok &= ((cells[:, 2] > 0) & (run[:, 2] < run[:, 2, :, -1:]))[..., None]
        elif ways == 2:
            ok[..., 1] &= (missing[:, 1] > 1e-6)[..., None]
        ok &= (hl >= self.p.min_child_weight) & (hr >= self.p.min_child_weight)
        bounds = (b[:, None, None, None] for b in (low, high))
        gain = np.where(ok, self._gain(gl, hl, gr, hr, gt, ht, *bounds, self.direction[None, :, None, None]), -np.inf)

        def split(k: int, at: int) -> Split:
            f, b, d = (int(v) for v in np.unravel_index(at, gain.shape[1:]))
            return Split(float(gain[k, f, b, d]), f, b, self._threshold(f, b, cells[k, 2, f]), bool(d), None, None, (gl[k, f, b, d], hl[k, f, b, d]), (gr[k, f, b, d], hr[k, f, b, d]))

        return gain, split

    def _best(self, hists: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Split]:
        found = [Split() for _ in hists]
        if (features & self.numeric).any():
            gain, split = self._numeric(hists, features, low, high)
            for k in range(len(hists)):
                if (at := _first_best(gain[k].ravel())) >= 0:
                    found[k] = split(k, at)
        for k in range(len(hists)):
            for f in np.flatnonzero(features[k] & ~self.numeric):
                found[k] = pick(self._by_category(hists[k], int(f), low[k], high[k]), found[k])
        return found

    def records(self, hists: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[Split]]:
        """For each node the candidates better than all before them, numeric ones first: whatever is best elsewhere, pick() can only take one of these."""
        out: list[list[Split]] = [[] for _ in hists]
        step = max(1, CELLS // (self.n * self.width))
        for a in range(0, len(hists), step):
            at = slice(a, a + step)
            if (features[at] & self.numeric).any():
                gain, split = self._numeric(hists[at], features[at], low[at], high[at])
                for k in range(len(gain)):
                    out[a + k] += [split(k, int(j)) for j in _records(gain[k].ravel())]
        for k in range(len(hists)):
            for f in np.flatnonzero(features[k] & ~self.numeric):
                out[k] += self._by_category(hists[k], int(f), low[k], high[k])
        return out

    def _by_category(self, hist: np.ndarray, f: int, low: float, high: float) -> list[Split]:
        """The candidates of categorical feature f that are better than those before them."""
        gt, ht = hist[0, -1], hist[1, -1]
        own = hist[:, self.base[f] : self.base[f + 1]]
        live = np.flatnonzero(own[2] > 0 if self.cuts.exact else own[1] > 0)
        if len(live) < 2:
            return []
        order = live[np.lexsort((live, own[0, live] / (own[1, live] + self.p.reg_lambda)))]
        gl, hl = np.cumsum(own[0, order])[:-1], np.cumsum(own[1, order])[:-1]
        gr, hr = gt - gl, ht - hl
        ok = (hl >= self.p.min_child_weight) & (hr >= self.p.min_child_weight)
        gain = np.where(ok, self._gain(gl, hl, gr, hr, gt, ht, low, high, np.zeros(len(gl))), -np.inf)
        out = []
        for k in _records(gain):
            bins = sorted(int(b) for b in order[: k + 1])
            out.append(Split(float(gain[k]), f, 0, 0.0, False, [max(0, int(self.cuts.cuts[f][b])) for b in bins], bins, (gl[k], hl[k]), (gr[k], hr[k])))
        return out

    def _threshold(self, f: int, b: int, counts: np.ndarray) -> float:
        c = self.cuts.cuts[f]
        if not self.cuts.exact:
            return float(c[b])
        above = b + 1 + int(np.flatnonzero(counts[b + 1 : len(c)] > 0)[0])
        return float(np.float32((float(c[b]) + float(c[above])) / 2))

    def _gain(self, gl, hl, gr, hr, gt, ht, low, high, direction):  # noqa: ANN001, ANN202
        p = self.p
        if not self.bounded and not p.alpha and not p.max_delta_step and p.min_child_weight > 0:
            # children under min_child_weight are ruled out already
            with np.errstate(divide="ignore", invalid="ignore"):
                return gl * gl / (hl + p.reg_lambda) + gr * gr / (hr + p.reg_lambda) - gt * gt / (ht + p.reg_lambda)
        if not self.bounded:
            return np_score(gl, hl, p) + np_score(gr, hr, p) - np_score(gt, ht, p)
        wl, wr, wt = np_weight(gl, hl, p, low, high), np_weight(gr, hr, p, low, high), np_weight(gt, ht, p, low, high)
        gain = np_score_at(gl, hl, wl, p) + np_score_at(gr, hr, wr, p) - np_score_at(gt, ht, wt, p)
        return np.where(((direction > 0) & (wl > wr)) | ((direction < 0) & (wl < wr)), -np.inf, gain)


def _records(gain: np.ndarray) -> np.ndarray:
    """Where a gain is over 0 and over all before it."""
    return np.flatnonzero(gain > np.maximum.accumulate(np.append(0.0, gain[:-1])))


def pick(candidates: Iterable[Split], best: Split) -> Split:
    """What is best after the candidates, each of which is taken if it gains EPS more than the one before."""
    for c in candidates:
        if c.gain > best.gain + EPS:
            best = c
    return best


def _first_best(gain: np.ndarray, best: float = 0.0) -> int:
    """What a scan ends at that takes a candidate only if it gains EPS more than the one before; -1 if none."""
    top = np.maximum.accumulate(np.append(best, gain[:-1]))
    at = -1
    for k in np.flatnonzero(gain > top):
        if gain[k] > best + EPS:
            best, at = gain[k], int(k)
    return at


def draw(numbers: np.ndarray | list[int], seed: int, turn: int, output: int = 0, what: int = 0, place: int = 0) -> np.ndarray:
    """A hash under 2**32 of each number and the rest, in arithmetic that any engine has."""
    v = (np.asarray(numbers, np.uint64) + np.uint64(1)) * np.uint64(2654435761)
    v = (v + np.uint64((seed * 40503 + turn * 9973 + output * 7919 + what * 6007 + place * 104729 + 12345) & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        v = ((v ^ (v >> np.uint64(16))) * np.uint64(73244475)) & np.uint64(0xFFFFFFFF)
    return v ^ (v >> np.uint64(16))


#: What draws are for.
BY_TREE, BY_LEVEL, BY_NODE, SKIP, DROP, ONE = range(6)


def dropped_trees(p: TrainingParams, turn: int, grown: int) -> list[int]:
    """Which of the trees so far a round of dropout leaves out: none if it is skipped, else at least one."""
    if not grown or draw([0], p.seed, turn, what=SKIP)[0] < p.skip_drop * (1 << 32):
        return []
    drops = draw(np.arange(grown), p.seed, turn, what=DROP) < p.rate_drop * (1 << 32)
    return np.flatnonzero(drops).tolist() or [int(draw([0], p.seed, turn, what=ONE)[0]) % grown]


class Columns:
    """Column sampling that depends on the seed, round, output and a node's path alone: those of the smallest draws."""

    def __init__(self, p: TrainingParams, n: int, turn: int, output: int) -> None:
        self.p, self.n, self.turn, self.output = p, n, turn, output
        self.pool = self._take(np.arange(n), p.colsample_bytree, BY_TREE, 0)

    def _take(self, pool: np.ndarray, ratio: float, what: int, place: int) -> np.ndarray:
        if ratio >= 1:
            return pool
        k = min(len(pool), max(1, round(ratio * len(pool))))
        return np.sort(pool[np.argsort(draw(pool, self.p.seed, self.turn, self.output, what, place), kind="stable")[:k]])

    def mask(self, path: str) -> np.ndarray:
        """path: the sides taken from the root, as l and r."""
        pool = self._take(self.pool, self.p.colsample_bylevel, BY_LEVEL, len(path))
        node = int("1" + path.replace("l", "0").replace("r", "1"), 2) % (1 << 31)
        pool = self._take(pool, self.p.colsample_bynode, BY_NODE, len(path) if self.p.method == "exact" else node)
        m = np.zeros(self.n, bool)
        m[pool] = True
        return m


@dataclass
class _Node:
    id: int
    path: str
    hist: np.ndarray
    low: float = -np.inf
    high: float = np.inf
    used: list[int] = field(default_factory=list)
    split: Split | None = None


def grow(p: TrainingParams, cuts: Cuts, columns: Columns, histograms: Callable[[Tree, list[int]], np.ndarray]) -> Tree:
    """A tree; histograms(tree, nodes) sums the rows of some of its leaves. Of two siblings only the lighter is summed."""
    tree, search = Tree(), Searcher(cuts, p)
    everything = [list(g) for g in p.interaction_constraints]

    def mask(node: _Node) -> np.ndarray:
        m = columns.mask(node.path)
        if everything:
            allowed = np.zeros(search.n, bool)
            allowed[sorted(allowed_features(node.used, everything, search.n))] = True
            m = m & allowed
        return m

    def evaluate(nodes: list[_Node]) -> None:
        if nodes:
            found = search.best(np.stack([n.hist for n in nodes]), np.stack([mask(n) for n in nodes]), np.array([n.low for n in nodes]), np.array([n.high for n in nodes]))
            for node, split in zip(nodes, found, strict=True):
                node.split = split

    def good(node: _Node) -> bool:
        s = node.split
        return s is not None and s.feature >= 0 and s.gain > EPS and s.gain > p.gamma and not (p.max_depth and len(node.path) >= p.max_depth)

    def divide(nodes: list[_Node]) -> list[_Node]:
        """Split nodes and evaluate their children, all with one call of histograms."""
        pairs, ask = [], []
        for node in nodes:
            s = node.split
            l, r = tree.split(node.id, s.feature, s.threshold, s.default_left, s.gain, s.bin, s.categories, s.left_bins)
            bounds = [(node.low, node.high)] * 2
            way = search.direction[s.feature]
            if way:
                wl, wr = (float(np_weight(np.float64(g), np.float64(h), p, node.low, node.high)) for g, h in (s.left, s.right))
                mid = (wl + wr) / 2
                bounds = [(node.low, mid), (mid, node.high)] if way > 0 else [(mid, node.high), (node.low, mid)]
            small_left = s.left[1] <= s.right[1]
            pairs.append((node, l, r, bounds, small_left))
            ask.append(l if small_left else r)
        got = histograms(tree, ask)
        made = []
        for (node, l, r, bounds, small_left), hist in zip(pairs, got, strict=True):
            other = node.hist - hist
            left, right = (hist, other) if small_left else (other, hist)
            node.hist = None
            for child, side, h, b in ((l, "l", left, bounds[0]), (r, "r", right, bounds[1])):
                made.append(_Node(child, node.path + side, h, *b, [*node.used, node.split.feature]))
                weigh(made[-1])
        evaluate([m for m in made if not (p.max_depth and len(m.path) >= p.max_depth)])
        return made

    def weigh(node: _Node) -> None:
        g, h = node.hist[0, -1], node.hist[1, -1]
        tree.value[node.id] = float(np_weight(np.float64(g), np.float64(h), p, node.low, node.high))
        tree.hess[node.id] = float(h)

    root = _Node(0, "", histograms(tree, [0])[0])
    weigh(root)
    evaluate([root])
    if p.grow_policy == "depthwise":
        level = [root]
        while level := [n for n in level if good(n)]:
            level = divide(level)
    else:
        count, heap = 1, [(-root.split.gain, "", root)] if good(root) else []
        while heap and (not p.max_leaves or count < p.max_leaves):
            node = heapq.heappop(heap)[2]
            for child in divide([node]):
                if good(child):
                    heapq.heappush(heap, (-child.split.gain, child.path, child))
            count += 1
    return tree


def drawn_pairs(n: int, max_pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """functions.ranking's drawn pairs of a query of n rows, by their ranks in order of row."""
    rank = np.arange(n, dtype=np.int64)
    times = (rank + 1) * max_pairs // n - rank * max_pairs // n
    a = np.repeat(rank, times)
    turn = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    v = (a * 2654435761 + turn * 40503 + seed % (1 << 20) * 9973 + 12345) & 0xFFFFFFFF
    for _ in range(2):
        v = ((v ^ (v >> 16)) * 73244475) & 0xFFFFFFFF
    return a, (a + 1 + (v ^ (v >> 16)) % (n - 1)) % n


def _pairs(y: np.ndarray, max_pairs: int, seed: int):  # noqa: ANN202
    """(better, worse) rows of a query in parts: all pairs of unlike labels, or the drawn ones of a query of more than max_pairs (0: never)."""
    n = len(y)
    if max_pairs and n * (n - 1) // 2 > max_pairs:
        a, b = drawn_pairs(n, max_pairs, seed)
        a, b = a[y[a] != y[b]], b[y[a] != y[b]]
        yield np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
        return
    step = max(1, (1 << 22) // n)
    for at in range(0, n, step):
        hi, lo = np.nonzero(y[at : at + step, None] > y[None])
        yield hi + at, lo


def np_lambda(kind: str, m: np.ndarray, y: np.ndarray, w: np.ndarray, group: np.ndarray, row: np.ndarray, max_pairs: int = 4096, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """LambdaMART gradients of functions.ranking for arrays, a query at a time."""
    g, h = np.zeros(len(m)), np.zeros(len(m))
    order = np.lexsort((row, group))
    bounds = np.append(np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1)), len(order))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        at = order[s:e]
        yy, mm, n = y[at], m[at], e - s
        if n < 2:
            continue
        pos = np.empty(n, int)
        pos[np.lexsort((np.arange(n), -mm))] = np.arange(n)
        disc = 1 / np.log2(pos + 2)
        ideal = ((2.0 ** np.sort(yy)[::-1] - 1) / np.log2(np.arange(n) + 2)).sum()
        rel = np.zeros(n)
        rel[pos] = yy > 0
        hits, part, total = np.cumsum(rel), np.cumsum(rel / (np.arange(n) + 1)), rel.sum()
        for hi, lo in _pairs(yy, max_pairs, seed):
            if kind == "pairwise":
                d = np.ones(len(hi))
            elif kind == "ndcg":
                d = np.abs((2.0 ** yy[hi] - 2.0 ** yy[lo]) * (disc[hi] - disc[lo])) / ideal if ideal > 0 else np.zeros(len(hi))
            else:
                a, b = np.minimum(pos[hi], pos[lo]), np.maximum(pos[hi], pos[lo])
                shift = rel[b] - rel[a]
                between = part[b] - part[a] - rel[b] / (b + 1)
                d = np.abs(rel[b] * (hits[a] + shift) / (a + 1) + rel[a] * hits[b] / (b + 1) - rel[a] * hits[a] / (a + 1) - rel[b] * hits[b] / (b + 1) + shift * between) / max(total, 1)
                d = np.where((yy[hi] > 0) & (yy[lo] <= 0), d, 0)
            live = d != 0
            hi, lo, d = hi[live], lo[live], d[live]
            rho = 1 / (1 + np.exp(mm[hi] - mm[lo]))
            gp, hp = rho * d, np.maximum(rho * (1 - rho) * d, 1e-16)
            g[at] += np.bincount(lo, gp, minlength=n) - np.bincount(hi, gp, minlength=n)
            h[at] += np.bincount(lo, hp, minlength=n) + np.bincount(hi, hp, minlength=n)
    return (g * w).astype(np.float32).astype(float), (h * w).astype(np.float32).astype(float)


def np_metric(name: str, p: np.ndarray, y: np.ndarray, w: np.ndarray, group: np.ndarray | None = None) -> float:
    """The metrics of functions.metrics for arrays."""
    base, _, given = name.partition("@")
    total = w.sum()
    mean = lambda v: float((v * w).sum() / total) if total > 0 else 0.0
    q = np.maximum(p, 1e-8) if base.endswith("nloglik") else p
    if base == "rmse":
        return mean((p - y) ** 2) ** 0.5
    if base == "mae":
        return mean(np.abs(p - y))
    if base == "logloss":
        c = np.clip(p, 1e-15, 1 - 1e-15)
        return mean(-(y * np.log(c) + (1 - y) * np.log(1 - c)))
    if base == "error":
        return mean((p > 0.5) != (y > 0.5))
    if base == "mlogloss":
        return mean(-np.log(np.clip(p[np.arange(len(y)), y.astype(int)], 1e-15, 1)))
    if base == "merror":
        return mean(p.argmax(1) != y)
    if base == "poisson-nloglik":
        return mean(q - y * np.log(q))
    if base == "gamma-nloglik":
        return mean(y / q + np.log(q))
    if base == "tweedie-nloglik":
        r = float(given) if given else 1.5
        return mean(-y * q ** (1 - r) / (1 - r) + q ** (2 - r) / (2 - r))
    if base in ("auc", "aucpr"):
        values, index = np.unique(p, return_inverse=True)
        ww = np.ones_like(w) if base == "auc" else w
        pos, neg = np.bincount(index, ww * (y > 0.5)), np.bincount(index, ww * (y <= 0.5))
        if pos.sum() == 0 or neg.sum() == 0:
            return 0.5 if base == "auc" else 0.0
        if base == "auc":
            return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))
        tp, fp = np.cumsum(pos[::-1]), np.cumsum(neg[::-1])
        use = tp + fp > 0
        prec, rec = tp[use] / (tp + fp)[use], tp[use] / pos.sum()
        return float((np.diff(rec, prepend=0) * (prec + np.append(prec[:1], prec[:-1])) / 2).sum())
    k = int(given) if given else None
    group = np.zeros(len(y), int) if group is None else group
    order = np.lexsort((np.arange(len(y)), -p, group))
    bounds = np.append(np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1)), len(order))
    out = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        yy = y[order[s:e]]
        if base == "ndcg":
            dcg = lambda v: float(((2.0 ** v[:k] - 1) / np.log2(np.arange(len(v[:k])) + 2)).sum())
            ideal = dcg(np.sort(yy)[::-1])
            out.append(dcg(yy) / ideal if ideal > 0 else 0.0)
        else:
            rel = yy > 0
            prec = np.cumsum(rel) / (np.arange(len(rel)) + 1)
            out.append(float((prec * rel)[:k].sum() / rel.sum()) if rel.any() else 0.0)
    return float(np.mean(out)) if out else 0.0
