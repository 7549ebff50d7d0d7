"""Training parameters with the customary names, defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from gradloom.errors import InvalidParameter

BOOSTERS = ("gbtree", "gblinear", "dart")
TREE_METHODS = ("auto", "hist", "exact", "approx")
GROW_POLICIES = ("depthwise", "lossguide")


@dataclass(frozen=True)
class TrainingParams:
    """All settings of a training run; `with_` derives changed copies, and every construction validates."""

    booster: str = "gbtree"
    seed: int = 0
    objective: str = "reg:squarederror"
    num_class: int = 0
    base_score: float | None = None
    eval_metric: tuple[str, ...] = ()
    eta: float = 0.3
    gamma: float = 0.0
    max_depth: int = 6
    max_leaves: int = 0
    min_child_weight: float = 1.0
    max_delta_step: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    reg_lambda: float = 1.0
    alpha: float = 0.0
    scale_pos_weight: float = 1.0
    tree_method: str = "auto"
    grow_policy: str = "depthwise"
    max_bin: int = 256
    monotone_constraints: tuple[int, ...] = ()
    interaction_constraints: tuple[tuple[int, ...], ...] = ()
    rate_drop: float = 0.0
    skip_drop: float = 0.0
    missing: float = float("nan")
    tweedie_variance_power: float = field(default=1.5)
    #: Ranking: a query of more pairs has this many drawn; 0 uses all pairs.
    max_pairs: int = 4096
    #: Accepted and unused: Spark sets how many cores work.
    nthread: int = 0

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise InvalidParameter(what)

        need(self.booster in BOOSTERS, f"booster must be one of {BOOSTERS}")
        need(self.tree_method in TREE_METHODS, f"tree_method must be one of {TREE_METHODS}")
        need(self.grow_policy in GROW_POLICIES, f"grow_policy must be one of {GROW_POLICIES}")
        need(self.eta > 0, "eta must be over 0")
        for name in ("gamma", "min_child_weight", "max_delta_step", "reg_lambda", "alpha", "max_depth", "max_leaves", "max_pairs"):
            need(getattr(self, name) >= 0, f"{name} must not be negative")
        need(self.scale_pos_weight > 0, "scale_pos_weight must be over 0")
        need(0 < self.subsample <= 1, "subsample must be in (0, 1]")
        for name in ("colsample_bytree", "colsample_bylevel", "colsample_bynode", "rate_drop", "skip_drop"):
            need(0 <= getattr(self, name) <= 1, f"{name} must be in [0, 1]")
        need(self.max_bin >= 2, "max_bin must be at least 2")
        need(all(c in (-1, 0, 1) for c in self.monotone_constraints), "monotone constraints are -1, 0 or 1")
        need(self.grow_policy != "lossguide" or self.max_leaves > 0 or self.max_depth > 0, "lossguide needs max_leaves or max_depth")
        need(not (self.tree_method == "exact" and self.grow_policy == "lossguide"), "the exact method grows depthwise only")

    def with_(self, **changes: object) -> TrainingParams:
        return replace(self, **changes)

    @property
    def method(self) -> str:
        """The tree method that auto stands for."""
        return "hist" if self.tree_method == "auto" else self.tree_method
