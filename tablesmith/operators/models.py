"""Model registry (M1–M9): battery slot name -> Spark ML estimator, with the fixed defaults and search spaces.

Slots whose single-machine solver has no Spark counterpart are re-aimed (see README): the two boosting slots are chains of
trees grown in shared passes (``boosting``), the deeper one with a ridge on leaf values and row sampling; the forest is grown by
``forest``; the RBF SVM is a
linear SVM, and the RBF SVR a Huber-loss linear regression, on random Fourier features of the kernel, fitted in shared passes (``kernel``); KNN is
the exact distributed search of ``knn``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tablesmith.operators.boosting import Boost
from tablesmith.operators.forest import Forest
from tablesmith.operators.kernel import KernelSlot

# Slots that are boosted in shared passes (``boosting``), and those on random features (``kernel``).
BOOSTED = ("GradientBoosting", "GradientBoostingDeep")
KERNELS = ("SVM", "SVR")

# Battery order per problem type (fixed).
CLASSIFIERS = ["LogisticRegression", "RandomForest", "GradientBoosting", "GradientBoostingDeep", "SVM", "KNN"]
REGRESSORS = ["LinearRegression", "RandomForest", "GradientBoosting", "GradientBoostingDeep", "SVR", "KNN"]

# Search spaces (fixed ranges): name -> (kind, low, high) / ("choice", [values]).
SEARCH_SPACES = {
    "LogisticRegression": {"C": ("log", 1e-4, 1e2)},
    "LinearRegression": {"fit_intercept": ("choice", [True, False])},
    "RandomForest": {"n_estimators": ("int", 50, 200), "max_depth": ("int", 3, 12)},
    "GradientBoosting": {"learning_rate": ("log", 0.01, 0.2), "n_estimators": ("int", 50, 200),
                         "max_depth": ("int", 3, 8)},
    "GradientBoostingDeep": {"learning_rate": ("log", 0.01, 0.2), "n_estimators": ("int", 50, 200),
                             "max_depth": ("int", 3, 10)},
    "SVM": {"C": ("log", 1e-3, 1e2), "gamma": ("choice", ["scale", "auto"])},
    "SVR": {"C": ("log", 1e-3, 1e2), "gamma": ("choice", ["scale", "auto"])},
    "KNN": {"n_neighbors": ("int", 3, 15), "weights": ("choice", ["uniform", "distance"])},
}

# Depth of a forest without a limit of its own.
DEFAULT_FOREST_DEPTH = 30
# Leaves of a tree at most, where a caller of ``build_estimator`` asks for a bounded forest by its rows.
FOREST_LEAVES = 8000


def forest_of(trees: int, depth: int | None = None, all_features: bool = False, seed: int = 42, least: int = 1) -> Forest:
    """A forest whose leaves may hold a single row, whatever the size of the table; ``least`` asks for more."""
    return Forest(trees, depth or DEFAULT_FOREST_DEPTH, least, all_features, seed)


def bounded_leaf(rows: int) -> int:
    """Least rows of a leaf of a forest that is asked to stay small: a fifth of the root of the rows, or 1 / ``FOREST_LEAVES`` of them."""
    return max(1, math.isqrt(rows) // 5, rows // FOREST_LEAVES)


# A user's own learner for a slot: ``ESTIMATOR_HOOKS[slot] = f(problem_type, params, seed) -> Spark ML estimator`` with
# ``features`` and ``label`` as its input columns. It takes the slot's place in the battery, in tuning and in the refit.
ESTIMATOR_HOOKS: dict = {}


@dataclass
class KNNConfig:
    """Marker 'estimator' of the KNN slot (the search itself lives in ``knn.knn_predict``)."""
    k: int = 5
    weights: str = "uniform"


def slots(problem_type: str) -> list[str]:
    return list(CLASSIFIERS if problem_type == "classification" else REGRESSORS)


def build_estimator(model_id: str, problem_type: str, params: dict | None = None, *, n_train: int = 1,
                    n_classes: int = 2, seed: int = 42):
    """M9: unfitted estimator for a slot name (``featuresCol='features'``, ``labelCol='label'``); KNN, kernel and boosted slots give the
    settings of the library's own learners. ``n_train`` sets the penalties of the slots that have one; a forest takes it as the wish for
    a small model (``bounded_leaf``), so that training, which wants the whole one, leaves it out there."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    p = dict(params or {})
    model_id = model_id.replace(" (Tuned)", "")
    clf = problem_type == "classification"
    n = max(1, n_train)
    if model_id in ESTIMATOR_HOOKS:
        return ESTIMATOR_HOOKS[model_id](problem_type, p, seed)
    if model_id == "LogisticRegression" and clf:
        # C * sum(loss) + 1/2 |w|^2  ==  mean(loss) + regParam/2 |w|^2 with regParam = 1 / (C n)
        return LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n), elasticNetParam=0.0, standardization=False,
                                  maxIter=1000, tol=1e-10, family="auto")
    if model_id == "LinearRegression" and not clf:
        return LinearRegression(regParam=0.0, solver="normal", fitIntercept=bool(p.get("fit_intercept", True)))
    if model_id == "RandomForest":
        return forest_of(int(p.get("n_estimators", 100)), p.get("max_depth"), not clf, seed, bounded_leaf(n))
    if model_id in BOOSTED:
        deep = model_id == "GradientBoostingDeep"
        return Boost(int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.1)), int(p.get("max_depth", 6 if deep else 3)),
                     *((1.0, 1.0, 0.8) if deep else (0.0, 1e-3, 1.0)))
    if model_id == "SVM" and clf:
        return KernelSlot("hinge", 1.0 / (p.get("C", 1.0) * n), p.get("gamma", "scale"))
    if model_id == "SVR" and not clf:
        return KernelSlot("huber", 1.0 / (p.get("C", 1.0) * n), p.get("gamma", "scale"))
    if model_id == "KNN":
        return KNNConfig(k=int(p.get("n_neighbors", 5)), weights=p.get("weights", "uniform"))
    raise ValueError(f"no {problem_type} slot is named {model_id!r}; there are {', '.join(slots(problem_type))}")


def sample_params(model_id: str, n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded random search over the slot's space (the sequential Bayesian sampler is not reproduced)."""
    space = SEARCH_SPACES.get(model_id.replace(" (Tuned)", ""), {})
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n_trials):
        trial = {}
        for name, spec in space.items():
            if spec[0] == "log":
                trial[name] = float(np.exp(rng.uniform(np.log(spec[1]), np.log(spec[2]))))
            elif spec[0] == "int":
                trial[name] = int(rng.randint(spec[1], spec[2] + 1))
            else:
                trial[name] = spec[1][rng.randint(len(spec[1]))]
        out.append(trial)
    return out
