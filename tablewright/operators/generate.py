"""Generated features: polynomial terms and ratios, as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.schema import numeric_columns


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def polynomial_terms(columns: Sequence[str], degree: int = 2, interaction_only: bool = False) -> dict[str, Column]:
    """Products of two or more factors, named ``poly__a^2`` and ``poly__a b``."""
    pick = combinations if interaction_only else combinations_with_replacement
    terms = {}
    for size in range(2, degree + 1):
        for factors in pick(columns, size):
            powers = {c: factors.count(c) for c in dict.fromkeys(factors)}
            name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            product = _filled(factors[0])
            for c in factors[1:]:
                product = product * _filled(c)
            terms[f"poly__{name}"] = product
    return terms


def ratio_terms(columns: Sequence[str]) -> dict[str, Column]:
    """``ratio__a__b`` of every pair; a missing or zero denominator gives 0."""
    return {
        f"ratio__{a}__{b}": F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0))), F.lit(0.0))
        for a, b in combinations(columns, 2)
    }


def generate_features(df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2,
                      interactions: bool = True) -> DataFrame:
    """Append the generated columns of all inputs: polynomials, then ratios.

    Their number grows with the square of the inputs (for degree 2): name the inputs of a wide table.
    """
    columns = list(columns or numeric_columns(df))
    terms = polynomial_terms(columns, degree, interaction_only=not interactions)
    if interactions:
        terms.update(ratio_terms(columns))
    return df.select("*", *[value.alias(name) for name, value in terms.items()])
