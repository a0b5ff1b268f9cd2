"""Tail probabilities and inverse laws that Spark SQL does not offer."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SERIES_TERMS = 100


def kolmogorov_tail(statistic: Column, n_left: Column, n_right: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    left, right = n_left.cast("double"), n_right.cast("double")
    root = F.sqrt(left * right / (left + right)) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * root * root),
    )
    total = 2.0 * F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    # The alternating series does not settle for tiny arguments, where p is 1.
    return F.when(root < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _lower_gamma_series(shape: float, x: float) -> float:
    term = total = 1.0 / shape
    step = shape
    for _ in range(10_000):
        step += 1.0
        term *= x / step
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + shape * math.log(x) - math.lgamma(shape))


def _upper_gamma_fraction(shape: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - shape
    c, d = 1.0 / tiny, 1.0 / b
    result = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2.0
        d = 1.0 / (a * d + b or tiny)
        c = b + a / c or tiny
        change = c * d
        result *= change
        if abs(change - 1.0) < 1e-16:
            break
    return result * math.exp(-x + shape * math.log(x) - math.lgamma(shape))


def chi_square_tail(statistic: float | None, dof: int) -> float | None:
    """P(X >= statistic) of the chi-square law, for one number on the driver."""
    if statistic is None or dof < 1:
        return None
    shape, x = dof / 2.0, statistic / 2.0
    if x <= 0.0:
        return 1.0
    if x < shape + 1.0:
        return max(0.0, 1.0 - _lower_gamma_series(shape, x))
    return min(1.0, _upper_gamma_fraction(shape, x))


# Coefficients of Acklam's published rational approximation to the
# inverse normal law (relative error below 1.15e-9).
_CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                  6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
                3.754408661907416e00, 1.0)
_TAIL_START = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    result = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        result = result * x + F.lit(coefficient)
    return result


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = q * q
    centre = q * _polynomial(_CENTRE_TOP, r) / _polynomial(_CENTRE_BOTTOM, r)
    side = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _polynomial(_TAIL_TOP, side) / _polynomial(_TAIL_BOTTOM, side)
    return (
        F.when(p < _TAIL_START, tail)
        .when(p > 1.0 - _TAIL_START, -tail)
        .otherwise(centre)
    )
