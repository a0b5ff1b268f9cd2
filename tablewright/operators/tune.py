"""Cross-validation, model choice and parameter search on one cached table."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.boosting import HistogramBooster
from tablewright.operators.metrics import HIGHER_IS_BETTER, signed
from tablewright.operators.models import make_model, metric_table, run_parallel, scored_rows
from tablewright.operators.split import kfold, stratified_kfold
from tablewright.sources.stored_plans import storable

# The ranges searched for each model family. A list is a choice, two
# integers an integer range, two floats a range (on a log scale when it spans a factor
# above ten).
SEARCH_SPACES = {
    "linear": {"C": (0.01, 100.0), "alpha": (0.001, 100.0)},
    "xgboost": {"trees": (100, 1000), "rate": (0.01, 0.3), "depth": (3, 10), "row_share": (0.5, 1.0), "column_share": (0.5, 1.0),
                "l1": (0.0, 5.0), "l2": (0.5, 5.0)},
    "lightgbm": {"trees": (100, 2000), "rate": (0.01, 0.3), "leaves": (20, 300), "min_rows": (5, 100), "row_share": (0.5, 1.0),
                 "column_share": (0.5, 1.0), "l1": (0.0, 5.0), "l2": (0.0, 5.0)},
    "catboost": {"trees": (100, 1000), "rate": (0.01, 0.3), "depth": (4, 10), "l2": (1.0, 10.0)},
    "forest": {"numTrees": (50, 300), "maxDepth": (3, 12)},
}


def default_metric(task: str) -> str:
    return "rmse" if task == "regression" else "roc_auc"


def with_folds(df: DataFrame, key: str, task: str, k: int, label: str = "label") -> DataFrame:
    return kfold(df, key, k) if task == "regression" else stratified_kfold(df, key, label, k)


def settings(estimator) -> str | None:
    """What an estimator does with given rows, as text; None where it does not say."""
    if isinstance(estimator, HistogramBooster):
        return repr((estimator.task, estimator.options, estimator.n_classes, estimator.validation))
    if hasattr(estimator, "extractParamMap"):
        return repr((type(estimator).__name__, sorted((p.name, repr(v)) for p, v in estimator.extractParamMap().items())))
    return None


@dataclass
class FoldFits:
    """What was learnt on one table of folds: estimators of equal settings are fitted and scored once."""

    folds: list[int] | None = None
    models: dict[str, dict[int, object]] = field(default_factory=dict)
    scores: dict[tuple[str, str], float | None] = field(default_factory=dict)

    def of(self, estimator) -> dict[int, object]:
        """Fitted models by the fold that was left out."""
        return self.models.get(settings(estimator), {})


def cross_validate(folded: DataFrame, make: Callable[[], object], task: str, n_classes: int = 2,
                   keep: Sequence[str] = (), threads: int = 4, fits: FoldFits | None = None) -> DataFrame:
    """Out-of-fold predictions of one estimator: (fold, keep..., y_true, y_pred, p...)."""
    fits = fits or FoldFits()
    if fits.folds is None:
        fits.folds = sorted(r["fold"] for r in folded.select("fold").distinct().collect())
    name = settings(make())
    fitted = fits.models.get(name)
    if fitted is None:
        fitted = dict(zip(fits.folds, run_parallel([lambda k=k: make().fit(folded.where(F.col("fold") != k)) for k in fits.folds], threads), strict=True))
        if name is not None:
            fits.models[name] = fitted
    parts = [
        scored_rows(fitted[k], folded.where(F.col("fold") == k), task, n_classes, ["fold", *keep])
        for k in fits.folds
    ]
    return reduce(DataFrame.unionByName, parts)


def cv_score(folded: DataFrame, make: Callable[[], object], task: str, metric: str, n_classes: int = 2,
             fits: FoldFits | None = None) -> float | None:
    """Mean of a metric over the folds; None where it cannot be computed."""
    fits = fits or FoldFits()
    name = settings(make())
    if (name, metric) in fits.scores:
        return fits.scores[name, metric]
    oof = cross_validate(folded, make, task, n_classes, fits=fits)
    by = ["fold"]
    table = metric_table(oof, task, n_classes, by, metric)
    if metric not in table.columns:
        table = metric_table(oof, task, n_classes, (), metric)
    value = table.agg(F.avg(metric)).first()[0]
    if name is not None:
        fits.scores[name, metric] = value
    return value


@storable
@dataclass(frozen=True)
class Candidate:
    """A model family with parameters and its score, larger is better."""

    name: str
    params: dict
    value: float | None
    metric: str

    @property
    def rank_key(self) -> float:
        turned = signed(self.metric, self.value)
        return -math.inf if turned is None or math.isnan(turned) else turned


def select_models(folded: DataFrame, names: Sequence[str], task: str, metric: str | None = None, n_classes: int = 2,
                  n_best: int = 3, params: dict[str, dict] | None = None, n_rows: int | None = None,
                  fits: FoldFits | None = None) -> list[Candidate]:
    """Score every candidate by cross-validation and keep the best ones."""
    metric = metric or default_metric(task)
    if metric not in HIGHER_IS_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    n_rows = n_rows if n_rows is not None else folded.count()
    found, fits = [], fits or FoldFits()
    for name in names:
        chosen = (params or {}).get(name, {})
        value = cv_score(folded, lambda name=name, p=chosen: make_model(name, task, n_classes, n_rows, p), task, metric, n_classes, fits)
        found.append(Candidate(name, chosen, value, metric))
    return sorted(found, key=lambda c: c.rank_key, reverse=True)[:n_best]


def draw(space: dict, rng: random.Random) -> dict:
    """One random point of a search space."""
    point = {}
    for name, choice in space.items():
        if isinstance(choice, list):
            point[name] = rng.choice(choice)
        elif all(isinstance(x, int) for x in choice):
            point[name] = rng.randint(*choice)
        else:
            low, high = choice
            if low > 0 and high / low > 10:
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.uniform(low, high)
    return point


def search(folded: DataFrame, name: str, task: str, space: dict | None = None, n_trials: int = 50,
           metric: str | None = None, n_classes: int = 2, seed: int = 42, n_rows: int | None = None,
           fits: FoldFits | None = None) -> list[Candidate]:
    """Seeded random search, best first; a failed trial has no value and comes last."""
    metric = metric or default_metric(task)
    space = space or SEARCH_SPACES[name]
    rng = random.Random(seed)
    n_rows = n_rows if n_rows is not None else folded.count()
    trials, fits = [], fits or FoldFits()
    for _ in range(n_trials):
        params = draw(space, rng)
        try:
            value = cv_score(folded, lambda p=params: make_model(name, task, n_classes, n_rows, p), task, metric, n_classes, fits)
        except Exception as error:  # noqa: BLE001  (one bad point must not end the search)
            trials.append(Candidate(name, {**params, "error": str(error)[:200]}, None, metric))
            continue
        trials.append(Candidate(name, params, value, metric))
    return sorted(trials, key=lambda c: c.rank_key, reverse=True)
