"""SQL that grows trees by itself, for the queries that train: what boosting should give, written as tables of candidates.

One tree is a chain of steps; each has, for every node, feature and value of the whole table, the sums on either side, picks a node's best
candidate and moves the rows. Thresholds among which no row of a node lies are one candidate to its rows, so the predictions agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from gradloom.operators.trees import allowed_features


def _weight(g: str, h: str) -> str:
    return f"CASE WHEN {h} < 1 THEN 0e0 ELSE least(greatest(-({g}) / ({h} + 1e0), lo), hi) END"


def _score(g: str, h: str) -> str:
    w = _weight(g, h)
    return f"CASE WHEN {h} < 1 THEN 0e0 ELSE -(2e0 * ({g}) * ({w}) + ({h} + 1e0) * ({w}) * ({w})) END"


def tree(name: str, src: str, g: str, h: str, features: Sequence[str], depth: int, monotone: Sequence[int] = (), groups: Sequence[Sequence[int]] = (), exact: bool = False, leaves: int = 0, known: str = "tr", columns: Callable[[str], Sequence[int]] | None = None) -> list[str]:
    """Common table expressions, the last called name: src with lw, the weight of the leaf of a tree that is learnt from the rows with tr.

    leaves: grow by largest gain, up to 3 of them. known: the rows whose values may be thresholds. columns: the features that may split a node, by its path.
    """
    n = len(features)
    way = list(monotone) + [0] * n
    used = [s for k in range(n + 1) for s in combinations(range(n), k)]
    allowed = " OR ".join(f"(used = {sum(1 << f for f in s)} AND feature IN ({', '.join(map(str, sorted(allowed_features(list(s), [list(x) for x in groups], n))))}))" for s in used if allowed_features(list(s), [list(x) for x in groups], n)) if groups else "true"
    paths = {0: ""}
    for node in range(2**depth - 1):
        paths |= {2 * node + 1: paths[node] + "l", 2 * node + 2: paths[node] + "r"}
    if columns:
        allowed = " OR ".join(f"(node = {k} AND feature IN ({', '.join(map(str, columns(path)))}))" for k, path in paths.items() if len(path) < depth)
    value = f"CASE b.feature {' '.join(f'WHEN {k} THEN CAST(r.{x} AS DOUBLE)' for k, x in enumerate(features))} END"
    values = " UNION ".join(f"SELECT {f} AS feature, CAST({x} AS DOUBLE) AS v FROM {src} WHERE {known} AND {x} IS NOT NULL" for f, x in enumerate(features))
    out = [f"{name}_v AS MATERIALIZED ({values})"]
    out += [f"{name}_r0 AS MATERIALIZED (SELECT s.*, 0 AS node, 0 AS used, -1e300 AS lo, 1e300 AS hi, CAST(CAST({g} AS FLOAT) AS DOUBLE) AS g, CAST(CAST({h} AS FLOAT) AS DOUBLE) AS h FROM {src} s)"]
    for k in range(depth):
        r = f"{name}_r{k}"
        cells = " UNION ALL ".join(f"SELECT node, {f} AS feature, CAST({x} AS DOUBLE) AS v, sum(g) AS g, sum(h) AS h FROM {r} WHERE tr AND {x} IS NOT NULL GROUP BY 1, 2, 3" for f, x in enumerate(features))
        # exact: only values that split the node's own rows; else all values of the table
        some = "WHERE hp0 > 0 AND hl0 > 0 AND hp0 - hl0 > 0" if exact else ""
        out += [
            f"{name}_c{k} AS MATERIALIZED ({cells})",
            f"{name}_t{k} AS MATERIALIZED (SELECT node, any_value(used) AS used, any_value(lo) AS lo, any_value(hi) AS hi, sum(g) AS gt, sum(h) AS ht FROM {r} WHERE tr GROUP BY node)",
            f"{name}_g{k} AS MATERIALIZED (SELECT t.*, v.feature, v.v AS thr, coalesce(c.g, 0e0) AS g, coalesce(c.h, 0e0) AS h FROM {name}_t{k} t CROSS JOIN {name}_v v LEFT JOIN {name}_c{k} c ON c.node = t.node AND c.feature = v.feature AND c.v = v.v)",
            f"{name}_s{k} AS MATERIALIZED (SELECT node, used, lo, hi, gt, ht, feature, thr, coalesce(sum(g) OVER a, 0e0) AS gl0, coalesce(sum(h) OVER a, 0e0) AS hl0, sum(g) OVER p AS gp0, sum(h) OVER p AS hp0 FROM {name}_g{k} WINDOW a AS (PARTITION BY node, feature ORDER BY thr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY node, feature))",
            f"{name}_d{k} AS MATERIALIZED (SELECT node, used, lo, hi, feature, thr, false AS dl, gl0 AS gl, hl0 AS hl, gt - gl0 AS gr, ht - hl0 AS hr, gt, ht FROM {name}_s{k} {some} UNION ALL SELECT node, used, lo, hi, feature, thr, true, gl0 + gt - gp0, hl0 + ht - hp0, gp0 - gl0, hp0 - hl0, gt, ht FROM {name}_s{k} {some + ' AND' if some else 'WHERE'} ht - hp0 > 1e-6)",
            f"{name}_w{k} AS MATERIALIZED (SELECT *, {_weight('gl', 'hl')} AS wl, {_weight('gr', 'hr')} AS wr, {_score('gl', 'hl')} + {_score('gr', 'hr')} - ({_score('gt', 'ht')}) AS gain, CASE feature {' '.join(f'WHEN {f} THEN {way[f]}' for f in range(n))} END AS way FROM {name}_d{k} WHERE hl >= 1 AND hr >= 1 AND ({allowed}))",
            f"{name}_b{k} AS MATERIALIZED (SELECT * FROM {name}_w{k} WHERE gain > 1e-6 AND NOT (way > 0 AND wl > wr) AND NOT (way < 0 AND wl < wr) QUALIFY row_number() OVER ({'' if leaves and k else 'PARTITION BY node '}ORDER BY round(gain, 6) DESC, feature, thr, dl) = 1)",
        ]
        left = f"coalesce({value} < b.thr, b.dl)"
        mid = "(b.wl + b.wr) / 2e0"
        move = f"CASE WHEN b.node IS NULL THEN r.node WHEN {left} THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END"
        lo = f"CASE WHEN b.node IS NULL OR b.way = 0 THEN r.lo WHEN {left} = (b.way > 0) THEN r.lo ELSE {mid} END"
        hi = f"CASE WHEN b.node IS NULL OR b.way = 0 THEN r.hi WHEN {left} = (b.way > 0) THEN {mid} ELSE r.hi END"
        out.append(f"{name}_r{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node, used, lo, hi), {move} AS node, r.used | coalesce(1 << b.feature, 0) AS used, {lo} AS lo, {hi} AS hi FROM {r} r LEFT JOIN {name}_b{k} b ON r.node = b.node)")
    last = f"{name}_r{depth}"
    out.append(f"{name}_l AS MATERIALIZED (SELECT node, {_weight('g', 'h')} AS lw FROM (SELECT node, any_value(lo) AS lo, any_value(hi) AS hi, sum(g) AS g, sum(h) AS h FROM {last} WHERE tr GROUP BY node))")
    out.append(f"{name} AS MATERIALIZED (SELECT r.* EXCLUDE (node, used, lo, hi, g, h), l.lw FROM {last} r JOIN {name}_l l ON r.node = l.node)")
    return out


SQUARED = ("m - y", "1e0")
LOGISTIC = ("1e0 / (1e0 + exp(-m)) - y", "greatest(1e0 / (1e0 + exp(-m)) * (1e0 - 1e0 / (1e0 + exp(-m))), 1e-16)")


def rounds(prefix: str, src: str, features: Sequence[str], depth: int, turns: int, loss: tuple[str, str] = SQUARED, margin: str = "avg(y)", eta: str = "3e-1", sampled: str | None = None, columns: Callable[[int, str], Sequence[int]] | None = None, **more: object) -> list[str]:
    """Common table expressions prefix_0 to prefix_turns: src (features, y, tr) with the margin m after each round; margin: the first, over the rows with tr.

    sampled: which rows learn in a round, with {turn}. columns: the features that may split a node, by round and path.
    """
    out = [f"{prefix}_0 AS MATERIALIZED (SELECT s.*, (SELECT {margin} FROM {src} WHERE tr) AS m FROM {src} s)"]
    for t in range(turns):
        own = f"{prefix}_{t}"
        if sampled:
            out.append(f"{prefix}_{t}s AS MATERIALIZED (SELECT * EXCLUDE (tr), {sampled.format(turn=t)} AS tr FROM {own})")
            own = f"{prefix}_{t}s"
        own_columns = {"columns": lambda path, t=t: columns(t, path)} if columns else {}
        out += tree(f"{prefix}_{t}t", own, *loss, features, depth, **({"known": "true"} if sampled else {}), **own_columns, **more)
        out.append(f"{prefix}_{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (m, lw), m + {eta} * lw AS m FROM {prefix}_{t}t)")
    return out


def drawn(number: int, seed: int, turn: int, what: int, place: int = 0) -> int:
    """The engine's draws for one output, in whole numbers."""
    v = ((number + 1) * 2654435761 + seed * 40503 + turn * 9973 + what * 6007 + place * 104729 + 12345) % 2**32
    for _ in range(2):
        v = (v ^ v >> 16) * 73244475 % 2**32
    return v ^ v >> 16


def sampled_columns(n: int, seed: int, tree_share: float, node_share: float) -> Callable[[int, str], list[int]]:
    """The features that column sampling by tree and by node leaves, by round and path."""

    def of(turn: int, path: str) -> list[int]:
        pool = list(range(n))
        for what, share, place in ((0, tree_share, 0), (2, node_share, int("1" + path.replace("l", "0").replace("r", "1"), 2))):
            if share < 1:
                pool = sorted(sorted(pool, key=lambda f, w=what, q=place: drawn(f, seed, turn, w, q))[: max(1, round(share * len(pool)))])
        return pool

    return of


def dart_rounds(src: str, features: Sequence[str], depth: int, turns: int, rate: float, skip: float, seed: int) -> list[str]:
    """Common table expressions, the last r: src with m after rounds of dropout. Which trees are dropped, and so all weights, don't depend on the rows: only the trees do."""
    out, weights = [f"b0 AS MATERIALIZED (SELECT s.*, (SELECT avg(y) FROM {src} WHERE tr) AS base FROM {src} s)"], []
    for t in range(turns):
        gone: list[int] = []
        if t and drawn(0, seed, t, 3) >= skip * 2**32:
            gone = [k for k in range(t) if drawn(k, seed, t, 4) < rate * 2**32] or [drawn(0, seed, t, 5) % t]
        rest = "".join(f" + {weights[k]!r}::DOUBLE * 3e-1 * w{k}" for k in range(t) if k not in gone)
        out += [f"i{t} AS MATERIALIZED (SELECT *, base{rest} AS m FROM b{t})", *tree(f"t{t}", f"i{t}", *SQUARED, features, depth)]
        out.append(f"b{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (m, lw), lw AS w{t} FROM t{t})")
        weights = [w * len(gone) / (len(gone) + 1) if k in gone else w for k, w in enumerate(weights)] + [1 / (len(gone) + 1)]
    return [*out, f"r AS (SELECT *, base{''.join(f' + {w!r}::DOUBLE * 3e-1 * w{k}' for k, w in enumerate(weights))} AS m FROM b{turns})"]
