"""How a tree grows: which leaves are searched next, which splits are taken and in what order. No rows in here.

Depthwise growth asks for a level at once. Loss-guided growth takes the leaf of the largest gain first; so that this isn't a search for each split, the children of
the best `AHEAD` leaves searched so far are searched together, and their parents are then accepted one by one in the queue's order. Splits that are searched below but never accepted stay in the
shadow tree, by which rows are routed, and are missing from the finished one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from gradloom.functions.gain import EPS, np_weight
from gradloom.operators.trees import allowed_features
from gradloom.params import TrainingParams
from gradloom.plans.kernel import Columns, Split, Tree

#: Leaves of the queue whose children are searched at once.
AHEAD = 64


@dataclass
class Leaf:
    """A leaf of the shadow tree; split is its best one, once searched; children, once it is split there."""

    id: int
    path: str = ""
    low: float = -np.inf
    high: float = np.inf
    used: list[int] = field(default_factory=list)
    split: Split | None = None
    children: list[Leaf] | None = None


class Growth:
    """asked: the leaves to search next, none once the tree is grown. answer() takes their best splits."""

    def __init__(self, p: TrainingParams, columns: Columns, n_features: int) -> None:
        self.p, self.columns, self.n = p, columns, n_features
        ways = list(p.monotone_constraints)[:n_features]
        self.ways = {f: way for f, way in enumerate(ways) if way}
        self.groups = [list(g) for g in p.interaction_constraints]
        self.all_columns = min(p.colsample_bytree, p.colsample_bylevel, p.colsample_bynode) >= 1
        self.shadow, self.root = Tree(), Leaf(0)
        self.asked: list[Leaf] = [self.root]
        self.accepted: list[Leaf] = []
        self.queue: list[tuple[float, str, Leaf]] = []
        self.fringe: list[Leaf] = []
        self.searches = 0

    def mask(self, leaf: Leaf) -> np.ndarray | None:
        """Which features may split a leaf; None: all."""
        m = None if self.all_columns else self.columns.mask(leaf.path)
        if self.groups:
            allowed = np.zeros(self.n, bool)
            allowed[sorted(allowed_features(leaf.used, self.groups, self.n))] = True
            m = allowed if m is None else m & allowed
        return m

    def start(self, g: float, h: float) -> None:
        """The root's sums."""
        self._weigh(self.root, g, h)

    def _weigh(self, leaf: Leaf, g: float, h: float) -> None:
        self.shadow.value[leaf.id] = float(np_weight(np.float64(g), np.float64(h), self.p, leaf.low, leaf.high))
        self.shadow.hess[leaf.id] = float(h)

    def _deep(self, leaf: Leaf) -> bool:
        return bool(self.p.max_depth) and len(leaf.path) >= self.p.max_depth

    def _good(self, leaf: Leaf) -> bool:
        s = leaf.split
        return s is not None and s.feature >= 0 and s.gain > EPS and s.gain > self.p.gamma and not self._deep(leaf)

    def _divide(self, leaf: Leaf) -> list[Leaf]:
        """Split a leaf in the shadow tree; gives the children that may be split in turn."""
        s = leaf.split
        ids = self.shadow.split(leaf.id, s.feature, s.threshold, s.default_left, s.gain, s.bin, s.categories, s.left_bins)
        bounds = [(leaf.low, leaf.high)] * 2
        if way := self.ways.get(s.feature):
            wl, wr = (float(np_weight(np.float64(g), np.float64(h), self.p, leaf.low, leaf.high)) for g, h in (s.left, s.right))
            mid = (wl + wr) / 2
            bounds = [(leaf.low, mid), (mid, leaf.high)] if way > 0 else [(mid, leaf.high), (leaf.low, mid)]
        leaf.children = [Leaf(k, leaf.path + side, *b, [*leaf.used, s.feature]) for k, side, b in zip(ids, "lr", bounds, strict=True)]
        for child, (g, h) in zip(leaf.children, (s.left, s.right), strict=True):
            self._weigh(child, g, h)
        return [c for c in leaf.children if not self._deep(c)]

    def answer(self, found: list[Split]) -> None:
        """The best splits of the asked leaves, in their order."""
        self.searches += 1
        for leaf, split in zip(self.asked, found, strict=True):
            leaf.split = split
        if self.p.grow_policy == "depthwise":
            good = [leaf for leaf in self.asked if self._good(leaf)]
            self.accepted += good
            self.asked = [child for leaf in good for child in self._divide(leaf)]
            return
        if self.searches == 1:
            self._push(self.root)
        self.fringe += [leaf for leaf in self.asked if self._good(leaf)]
        self.asked = []
        while self.queue and not self.asked and self._room():
            head = self.queue[0][2]
            if head.children is None:
                # the head, and the best of all leaves that have been searched, whether their parents are accepted yet or not
                rest = heapq.nsmallest(min(AHEAD, self._room()) - 1, ((-leaf.split.gain, leaf.path, leaf) for leaf in self.fringe if leaf is not head))
                self.asked = [child for leaf in (head, *(x[2] for x in rest)) for child in self._divide(leaf)]
                self.fringe = [leaf for leaf in self.fringe if leaf.children is None]
                continue
            heapq.heappop(self.queue)
            self.accepted.append(head)
            for child in head.children:
                self._push(child)

    def _room(self) -> int:
        """How many splits may still be accepted."""
        return self.p.max_leaves - 1 - len(self.accepted) if self.p.max_leaves else AHEAD

    def _push(self, leaf: Leaf) -> None:
        if self._good(leaf):
            heapq.heappush(self.queue, (-leaf.split.gain, leaf.path, leaf))

    def tree(self) -> Tree:
        """The accepted splits as a tree, numbered as they were accepted."""
        out, at = Tree(), {0: 0}
        for leaf in self.accepted:
            s = leaf.split
            ids = out.split(at[leaf.id], s.feature, s.threshold, s.default_left, s.gain, s.bin, s.categories, s.left_bins)
            at |= {child.id: k for child, k in zip(leaf.children, ids, strict=True)}
        for old, new in at.items():
            out.value[new], out.hess[new] = self.shadow.value[old], self.shadow.hess[old]
        return out
