"""Models in the JSON layout of XGBoost."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

from gradloom.errors import ModelFormatError
from gradloom.functions import objectives
from gradloom.model import BoostedModel
from gradloom.params import TrainingParams
from gradloom.plans.kernel import Tree

_NO_PARENT = 2147483647
_LOG_LINK = ("count:poisson", "reg:gamma", "reg:tweedie")


def export_json(model: BoostedModel) -> str:
    """Numeric tree models only: categorical splits, dropout weights, linear models and cut-off ones raise, as the layout would lose them."""
    if model.linear is not None or any(w != 1.0 for w in model.weights) or any(c is not None for t in model.trees for c in t.categories):
        raise ModelFormatError("only gbtree models with numeric splits can be exported")
    trees = []
    for k, t in enumerate(model.trees[: model.used_trees()]):
        n = len(t)
        parents = [_NO_PARENT] * n
        for i in range(n):
            if t.left[i] >= 0:
                parents[t.left[i]] = parents[t.right[i]] = i
        leaf = [t.left[i] < 0 for i in range(n)]
        trees.append({
            "base_weights": [float(v) for v in t.value], "categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": [],
            "default_left": [int(bool(d)) for d in t.default_left], "id": k, "left_children": list(t.left), "right_children": list(t.right), "parents": parents,
            "loss_changes": [float(g) for g in t.gain], "split_conditions": [float(t.value[i] if leaf[i] else np.float32(t.threshold[i])) for i in range(n)],
            "split_indices": [0 if leaf[i] else int(t.feature[i]) for i in range(n)], "split_type": [0] * n, "sum_hessian": [float(h) for h in t.hess],
            "tree_param": {"num_deleted": "0", "num_feature": str(model.n_features), "num_nodes": str(n), "size_leaf_vector": "1"},
        })
    name = model.objective.name
    score = model.base_score
    if model.outputs == 1:
        score = float(np.exp(score)) if name in _LOG_LINK else model.objective.margin_score(score)
    classes = model.outputs if model.outputs > 1 else 0
    kind: dict[str, Any] = {"name": name}
    if classes:
        kind["softmax_multiclass_param"] = {"num_class": str(classes)}
    elif name == "count:poisson":
        kind["poisson_regression_param"] = {"max_delta_step": "0.7"}
    elif name == "reg:tweedie":
        kind["tweedie_regression_param"] = {"tweedie_variance_power": str(model.params.tweedie_variance_power)}
    elif name == "reg:pseudohubererror":
        kind["pseudo_huber_param"] = {"huber_slope": "1"}
    else:
        kind["reg_loss_param"] = {"scale_pos_weight": str(model.params.scale_pos_weight)}
    return json.dumps({
        "learner": {
            "attributes": {}, "feature_names": [], "feature_types": [],
            "gradient_booster": {"name": "gbtree", "model": {"gbtree_model_param": {"num_parallel_tree": "1", "num_trees": str(len(trees))}, "tree_info": [i % model.outputs for i in range(len(trees))], "trees": trees}},
            "learner_model_param": {"base_score": repr(score), "boost_from_average": "1", "num_class": str(classes), "num_feature": str(model.n_features), "num_target": "1"},
            "objective": kind,
        },
        "version": [2, 0, 0],
    })


def import_json(text: str) -> BoostedModel:
    """gbtree models with numeric splits; numbers may be strings."""
    try:
        learner = json.loads(text)["learner"]
        booster = learner["gradient_booster"]
        if booster.get("name", "gbtree") != "gbtree":
            raise ModelFormatError(f"booster {booster['name']} can't be imported")
        own = learner["learner_model_param"]
        number = lambda v: float(str(v).strip("[]"))
        classes, name = int(number(own.get("num_class", 0))), learner["objective"]["name"]
        params = TrainingParams(objective=name, num_class=classes if classes > 1 else 0)
        objective = objectives.create(params)
        score = number(own.get("base_score", 0.5))
        if objective.outputs == 1:
            score = float(np.log(score)) if name in _LOG_LINK else objective.score_margin(score)
        model = BoostedModel(params, objective, int(number(own.get("num_feature", 0))), score)
        for d in booster["model"]["trees"]:
            left, right = [int(v) for v in d["left_children"]], [int(v) for v in d["right_children"]]
            n = len(left)
            if any(d.get("split_type", [0] * n)) or d.get("categories"):
                raise ModelFormatError("categorical splits can't be imported")
            cond = [number(v) for v in d.get("split_conditions") or d["base_weights"]]
            t = Tree([int(v) for v in d["split_indices"]], cond[:], [bool(number(v)) for v in d["default_left"]], left, right, [cond[i] if left[i] < 0 else 0.0 for i in range(n)])
            t.hess = [number(v) for v in d.get("sum_hessian", [1.0] * n)]
            t.gain = [number(v) for v in d.get("loss_changes", [0.0] * n)]
            t.categories, t.left_bins, t.bin = [None] * n, [None] * n, [0] * n
            model.trees.append(t)
            model.weights.append(1.0)
        return model
    except (KeyError, TypeError, ValueError) as e:
        if isinstance(e, ModelFormatError):
            raise
        raise ModelFormatError(f"not an XGBoost model: {e!r}") from e
