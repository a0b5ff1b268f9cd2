"""Scalers: parameters from one aggregate (or exact quantiles), applied as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tablewright.functions.tails import inverse_normal
from tablewright.operators.order import clean_number, column_extent, quantiles, running_sums
from tablewright.operators.schema import numeric_columns
from tablewright.sources.stored_plans import storable

STRATEGIES = ("standard", "minmax", "robust", "maxabs", "power", "quantile", "none")
_CLIP = 1e-7


def _real(df: DataFrame, column: str) -> Column:
    return clean_number(F.col(column), df.schema[column].dataType).cast("double")


@storable
@dataclass(frozen=True)
class LinearScale:
    """(x - centre) / width per column; a zero width divides by one."""

    centres: dict[str, float]
    widths: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda x, c: (x - F.lit(self.centres[c])) / F.lit(self.widths[c]))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda x, c: x * F.lit(self.widths[c]) + F.lit(self.centres[c]))

    def _apply(self, df: DataFrame, formula) -> DataFrame:
        return df.select(*[
            formula(_real(df, c), c).alias(c) if c in self.centres else F.col(c) for c in df.columns])


def fit_scaler(df: DataFrame, strategy: str = "robust", columns: Sequence[str] | None = None,
               quantile_range: tuple[float, float] = (0.25, 0.75), n_quantiles: int = 1000):
    """Fit on one table, apply to any; only numeric columns are scaled."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    columns = list(columns or numeric_columns(df))
    if strategy == "none" or not columns:
        return LinearScale({}, {})
    if strategy == "power":
        return fit_power(df, columns)
    if strategy == "quantile":
        return fit_quantile(df, columns, n_quantiles)
    values = {c: _real(df, c) for c in columns}
    if strategy == "robust":
        low, high = quantile_range
        cuts = quantiles(df, values, [low, 0.5, high])
        centres = {c: q[1] for c, q in cuts.items()}
        widths = {c: None if q[0] is None else q[2] - q[0] for c, q in cuts.items()}
    else:
        stats = {
            "standard": lambda v: (F.avg(v), F.stddev_pop(v)),
            "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)),
            "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
        }[strategy]
        cells = [stats(v) for v in values.values()]
        row = df.agg(*[x.alias(f"{k}{i}") for i, pair in enumerate(cells) for k, x in zip("cw", pair, strict=True)]).first()
        centres = {c: row[f"c{i}"] for i, c in enumerate(columns)}
        widths = {c: row[f"w{i}"] for i, c in enumerate(columns)}
    known = [c for c in columns if centres[c] is not None]
    return LinearScale({c: float(centres[c]) for c in known}, {c: float(widths[c] or 1.0) for c in known})


# --- power (Yeo-Johnson) ---------------------------------------------------------


def yeo_johnson(x: Column, power: float | Column) -> Column:
    """The transform for one exponent, given as a number or as a column."""
    p = power if isinstance(power, Column) else F.lit(float(power))
    rest = 2.0 - p
    right = F.when(F.abs(p) < 1e-12, F.log1p(x)).otherwise(F.try_divide(F.pow(x + 1.0, p) - 1.0, p))
    left = F.when(F.abs(rest) < 1e-12, -F.log1p(-x)).otherwise(-F.try_divide(F.pow(1.0 - x, rest) - 1.0, rest))
    return F.when(x >= 0, right).otherwise(left)


def inverse_yeo_johnson(y: Column, power: float) -> Column:
    if abs(power) < 1e-12:
        right = F.exp(y) - 1.0
    else:
        right = F.pow(y * power + 1.0, F.lit(1.0 / power)) - 1.0
    if abs(power - 2.0) < 1e-12:
        left = 1.0 - F.exp(-y)
    else:
        left = 1.0 - F.pow(1.0 - (2.0 - power) * y, F.lit(1.0 / (2.0 - power)))
    return F.when(y >= 0, right).otherwise(left)


@storable
@dataclass(frozen=True)
class PowerScale:
    """Yeo-Johnson with a fitted exponent per column, then standardised."""

    powers: dict[str, float]
    linear: LinearScale = field(default_factory=lambda: LinearScale({}, {}))

    def _bend(self, df: DataFrame, formula) -> DataFrame:
        return df.select(*[
            formula(_real(df, c), self.powers[c]).alias(c) if c in self.powers else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self._bend(df, yeo_johnson))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._bend(self.linear.inverse_transform(df), inverse_yeo_johnson)


def _bent(x: np.ndarray, p: float) -> np.ndarray:
    """``yeo_johnson`` of an array."""
    out, right, rest = np.empty(len(x)), x >= 0, 2.0 - p
    up, down = x[right], x[~right]
    out[right] = np.log1p(up) if abs(p) < 1e-12 else ((up + 1.0) ** p - 1.0) / p
    out[~right] = -np.log1p(-down) if abs(rest) < 1e-12 else -((1.0 - down) ** rest - 1.0) / rest
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(count, mean, squared deviation, jacobian) of two parts together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return np.array([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, a[3] + b[3]])


def _power_scores(values: DataFrame, grids: list[list[float]]) -> list[dict[int, float]]:
    """Log-likelihood of each column's exponents, where the bent values vary."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, powers in enumerate(grids):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                jacobian = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                for j, p in enumerate(powers):
                    with np.errstate(over="ignore", invalid="ignore"):
                        y = _bent(x, p)
                        mean = y[0] if y.min() == y.max() else y.mean()      # equal values have no spread at all
                        part = np.array([len(y), mean, ((y - mean) ** 2).sum(), jacobian])
                    held[i, j] = _merged(held[i, j], part) if (i, j) in held else part
        rows = [(*k, *v.tolist()) for k, v in held.items()]
        if rows:
            names = ["i", "j", "n", "mean", "squares", "jacobian"]
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    total: dict[tuple[int, int], np.ndarray] = {}
    # A task sends one row for each column and exponent.
    for r in values.mapInArrow(moments, "i int, j int, n double, mean double, squares double, jacobian double").collect():
        part = np.array([r["n"], r["mean"], r["squares"], r["jacobian"]])
        total[r["i"], r["j"]] = _merged(total[r["i"], r["j"]], part) if (r["i"], r["j"]) in total else part
    scores: list[dict[int, float]] = [{} for _ in grids]
    for (i, j), (n, _, squares, jacobian) in sorted(total.items()):
        if squares / n > 0:
            scores[i][j] = -n / 2.0 * math.log(squares / n) + (grids[i][j] - 1.0) * jacobian
    return scores


def fit_power(df: DataFrame, columns: Sequence[str], low: float = -3.0, high: float = 5.0,
              grid: int = 9, rounds: int = 7) -> PowerScale:
    """Maximum likelihood by a shrinking grid; one job per round.

    Tasks bend whole Arrow batches and send count, mean and squared deviation for each exponent.
    """
    columns = list(columns)
    values = df.select(*[_real(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    ends = {c: (low, high) for c in columns}
    best: dict[str, float] = dict.fromkeys(columns, 1.0)    # constant or empty: left as it is
    for _ in range(rounds):
        grids = {c: [a + (b - a) * j / (grid - 1) for j in range(grid)] for c, (a, b) in ends.items()}
        scores = _power_scores(values, [grids[c] for c in columns])
        for i, c in enumerate(columns):
            if scores[i]:
                best[c] = grids[c][-max((score, -j) for j, score in scores[i].items())[1]]
                step = grids[c][1] - grids[c][0]
                ends[c] = (best[c] - step, best[c] + step)
    return PowerScale(best, fit_scaler(PowerScale(best)._bend(df, yeo_johnson), "standard", columns))


# --- quantile to normal ----------------------------------------------------------


@storable
@dataclass(frozen=True)
class QuantileScale:
    """Piecewise-linear distribution function over a quantile grid, then the normal quantile."""

    grids: dict[str, tuple[float, ...]]
    normal: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        """Tasks place whole Arrow batches on the grid; the normal quantile is an expression."""
        todo = [c for c in df.columns if c in self.grids]
        shares = {}
        for c in todo:
            x = _real(df, c)
            shares[c] = _shares(self.grids[c])(x) if self._varies(c) else F.when(x.isNotNull(), 0.0)
        out = df
        out = out.withColumns({f"_p_{c}": share for c, share in shares.items()})

        def result(c: str) -> Column:
            p = F.col(f"_p_{c}")
            return inverse_normal(F.least(F.greatest(p, F.lit(_CLIP)), F.lit(1.0 - _CLIP))) if self.normal else p

        return out.select(*[result(c).alias(c) if c in self.grids else F.col(c) for c in df.columns])

    def _varies(self, column: str) -> bool:
        grid = self.grids[column]
        return len(grid) > 1 and grid[0] != grid[-1]

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("ties of the grid have no single inverse")


def _shares(grid: Sequence[float]):
    """Position of each value in the grid as a share of 1, missing values left out."""
    edges = np.array(grid, float)

    @pandas_udf("double")
    def placed(values: pd.Series) -> pd.Series:
        x = values.to_numpy(float)
        with np.errstate(invalid="ignore"):
            return pd.Series(np.where(np.isnan(x), np.nan, _grid_share(x, edges)))

    return placed


def _grid_share(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sides = []
    for side in ("right", "left"):
        # n edges are up to the value, or below it: it is between edge n-1 and edge n.
        at = np.clip(np.searchsorted(edges, x, side=side) - 1, 0, len(edges) - 2)
        left, width = edges[at], edges[at + 1] - edges[at]
        inside = np.where(width == 0, 0.0, (x - left) / np.where(width == 0, 1.0, width))
        inside = np.where(np.isnan(inside), 1.0, np.clip(inside, 0.0, 1.0))       # infinite edges
        sides.append((at + inside) / float(len(edges) - 1))
    # The mean of both sides gives ties of the grid their middle.
    return np.where(x <= edges[0], 0.0, np.where(x >= edges[-1], 1.0, (sides[0] + sides[1]) / 2.0))


def quantile_grid(df: DataFrame, columns: Sequence[str], n: int) -> dict[str, tuple[float, ...]]:
    """Exact quantiles at n evenly spaced probabilities.

    A few are found by histogram refinement; many by running counts over the distinct
    values, which places any number of quantiles in one pass.
    """
    values = {c: _real(df, c) for c in columns}
    if n * len(columns) <= 64:
        probabilities = [i / (n - 1) for i in range(n)]
        return {c: tuple(q) for c, q in quantiles(df, values, probabilities).items() if q[0] is not None}
    extent = column_extent(df, values)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()]))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, ["column"], "value", ["n"])
    sizes = F.create_map(*[F.lit(x) for c in columns for x in (c, extent[c][0])])
    step = (sizes[F.col("column")] - 1) / F.lit(float(n - 1))
    first, after = F.col("run_n") - F.col("n"), F.col("run_n")
    # Positions of the grid whose lower or upper neighbour is this value.
    low_j = F.greatest(F.lit(0), F.floor(F.try_divide(first - 1, step)).cast("int") - 1)
    high_j = F.least(F.lit(n - 1), F.ceil(F.try_divide(after + 1, step)).cast("int") + 1)
    spots = ranked.withColumn("_step", step).withColumn(
        "j", F.explode(F.when(F.col("_step") > 0, F.sequence(F.least(low_j, high_j), high_j)).otherwise(
            F.sequence(F.lit(0), F.lit(n - 1)))))
    position = F.round(F.col("j") * F.col("_step"), 9)
    is_low = (F.floor(position) >= first) & (F.floor(position) < after)
    is_high = (F.ceil(position) >= first) & (F.ceil(position) < after)
    found = (
        spots.where(is_low | is_high).groupBy("column", "j")
        .agg(F.max(F.when(is_low, F.col("value"))).alias("a"), F.max(F.when(is_high, F.col("value"))).alias("b"),
             F.max(position - F.floor(position)).alias("w"))
        .collect()
    )
    grids: dict[str, list] = {c: [None] * n for c in columns if extent[c][0]}
    for r in found:
        grids[r["column"]][r["j"]] = r["a"] + (r["b"] - r["a"]) * r["w"]
    return {c: tuple(g) for c, g in grids.items()}


def fit_quantile(df: DataFrame, columns: Sequence[str], n: int = 1000, normal: bool = True) -> QuantileScale:
    rows = df.count()
    return QuantileScale(quantile_grid(df, columns, max(2, min(n, rows))), normal)


def normal_quantile(p: float) -> float:
    """Driver-side normal quantile for tests: bisection on the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 0.5 * math.erfc(-middle / math.sqrt(2.0)) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0
