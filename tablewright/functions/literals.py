"""Arrays of numbers as one literal expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: float | int, sql_type: str) -> str:
    if sql_type == "bigint":
        return f"{int(x)}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')"


def number_rows(rows: Sequence[Sequence[float]], sql_type: str = "double") -> Column:
    """Nested array literal, built with one call however many numbers it holds."""
    inner = ", ".join(
        f"cast(array({', '.join(_text(x, sql_type) for x in row)}) as array<{sql_type}>)" for row in rows)
    return F.expr(f"array({inner})")


def number_row(row: Sequence[float], sql_type: str = "double") -> Column:
    return F.expr(f"cast(array({', '.join(_text(x, sql_type) for x in row)}) as array<{sql_type}>)")
