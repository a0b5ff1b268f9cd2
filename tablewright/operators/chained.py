"""Chained regressions for missing values, solved from moments of each pattern of gaps.

Rows with the same columns missing (a pattern) get their gaps filled by the same affine map of
what they have. Sums over the rows that a regression needs therefore follow from the pattern's
sums of products of observed values: they are taken once, by tasks, and all rounds work on
those small matrices. The table is read twice in all, whatever the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.order import clean_number
from tablewright.operators.schema import numeric_columns
from tablewright.session import scratch_path
from tablewright.sources.stored_plans import storable

#: Numbers in all pattern matrices together that the driver holds (32 MB); with more, each
#: regression sums them up in tasks. Both ways give the same regressions.
DRIVER_NUMBERS = 4_000_000
#: Patterns that a task holds before it sends what it has.
TASK_PATTERNS = 2_000


def present(df: DataFrame, column: str) -> Column:
    return clean_number(F.col(f"`{column}`"), df.schema[column].dataType).cast("double")


@storable
@dataclass(frozen=True)
class ChainedFill:
    """Each incomplete column is regressed on all others, round after round.

    Applying it is a chain of narrow projections of the fitted regressions; columns complete at
    fit time are filled with their mean.
    """

    columns: tuple[str, ...]
    starts: dict[str, float]
    steps: tuple[tuple[str, float, tuple[float, ...]], ...] = field(default=())

    def transform(self, df: DataFrame) -> DataFrame:
        """The steps run over one array of values, so the plan grows with the rounds and not with their square."""
        place = {c: i for i, c in enumerate(self.columns)}
        seen = [present(df, c) for c in self.columns]
        out = df.withColumn("_seen", F.array(*seen)).withColumn(
            "_now", F.array(*[F.coalesce(F.get("_seen", F.lit(i)), F.lit(self.starts[c])) for i, c in enumerate(self.columns)]))
        if self.steps:
            table = F.array(*[F.struct(
                F.lit(place[target]).alias("at"), F.lit(float(intercept)).alias("base"),
                F.array(*[F.lit(float(w)) for w in self._widened(target, weights)]).alias("weights"))
                for target, intercept, weights in self.steps])

            def step(now: Column, s: Column) -> Column:
                products = F.zip_with(now, s["weights"], lambda v, w: v * w)
                filled = F.aggregate(products, s["base"], lambda total, v: total + v)
                value = F.coalesce(F.get(F.col("_seen"), s["at"]), filled)
                return F.transform(now, lambda v, i: F.when(i == s["at"], value).otherwise(v))

            out = out.withColumn("_now", F.aggregate(table, F.col("_now"), step))
        return out.select(*[F.get("_now", F.lit(place[c])).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])

    def _widened(self, target: str, weights: Sequence[float]) -> list[float]:
        """Weights over all columns, none for the target itself."""
        rest = iter(weights)
        return [0.0 if c == target else next(rest) for c in self.columns]


class _Moments:
    """Sums of products of the observed values (and 1) of the rows of each pattern."""

    def __init__(self, table: DataFrame, columns: Sequence[str], starts: dict[str, float], scales: dict[str, float]):
        self.p = p = len(columns)
        centre, width = np.array([starts[c] for c in columns]), np.array([scales[c] for c in columns])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                known = ~np.isnan(x)
                z = np.column_stack((np.ones(len(x)), np.where(known, (x - centre) / width, 0.0)))
                bits = np.packbits(known, axis=1)
                _, first, group = np.unique(bits, axis=0, return_index=True, return_inverse=True)
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(len(first) + 1))
                for g, at in enumerate(first):
                    rows = z[order[cuts[g]:cuts[g + 1]]]
                    key = bits[at].tobytes()
                    held[key] = held.get(key, 0.0) + rows.T @ rows
                if len(held) > TASK_PATTERNS:
                    yield _batch(held)
                    held = {}
            if held:
                yield _batch(held)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None
            for batch in batches:
                done: dict[bytes, np.ndarray] = {}
                for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    m = np.frombuffer(m)
                    if k == key:
                        total = total + m
                        continue
                    if key is not None:
                        done[key] = total
                    key, total = k, m
                if done:
                    yield _batch(done)
            if key is not None:
                yield _batch({key: total})

        schema = "pattern binary, moments binary"
        spark = table.sparkSession
        parts = table.select(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]).mapInArrow(partial, schema)
        path = scratch_path(spark, "moments")
        parts.repartition("pattern").sortWithinPartitions("pattern").mapInArrow(summed, schema).write.parquet(path)
        self.table = spark.read.schema(schema).parquet(path)
        self.held = None
        if self.table.count() * (p + 1) ** 2 <= DRIVER_NUMBERS:
            self.held = [(r["pattern"], np.frombuffer(r["moments"]).reshape(p + 1, p + 1)) for r in self.table.collect()]
            self.maps = [_start(k, p) for k, _ in self.held]

    def apply(self, target: int, row: np.ndarray) -> None:
        """From now on gaps of ``target`` are filled by this row of weights over (1, values)."""
        if self.held is not None:
            for (k, _), held in zip(self.held, self.maps):
                if not _has(k, target):
                    held[target + 1] = row @ held

    def gram(self, target: int, steps: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
        """Products of filled values, summed over the rows that have the target."""
        if self.held is not None:
            parts = [m @ s @ m.T for (k, s), m in zip(self.held, self.maps) if _has(k, target)]
            return np.sum(parts, axis=0) if parts else np.zeros((self.p + 1, self.p + 1))
        p = self.p

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((p + 1, p + 1))
            for batch in batches:
                for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if _has(k, target):
                        m = _start(k, p)
                        for at, row in steps:
                            if not _has(k, at):
                                m[at + 1] = row @ m
                        total += m @ np.frombuffer(s).reshape(p + 1, p + 1) @ m.T
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "v": total.ravel()})

        rows = self.table.mapInArrow(added, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((p + 1) ** 2)
        for r in rows:
            total[r["i"]] = r["v"]
        return total.reshape(p + 1, p + 1)


def _start(pattern: bytes, p: int) -> np.ndarray:
    """Map from (1, observed values) to (1, filled values): gaps start at the mean, which is 0."""
    return np.diag(np.concatenate(([1.0], np.unpackbits(np.frombuffer(pattern, np.uint8))[:p].astype(float))))


def _has(pattern: bytes, column: int) -> bool:
    return bool(pattern[column >> 3] >> (7 - (column & 7)) & 1)


def _batch(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "pattern": pa.array(list(held), pa.binary()), "moments": pa.array([np.ascontiguousarray(m).tobytes() for m in held.values()], pa.binary())})


def fit_chained(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 10,
                ridge: float = 1e-6, tolerance: float = 1e-3) -> ChainedFill:
    """Chained ridge regressions; columns with fewest gaps first.

    Stops when no standardised coefficient of a round moves by ``tolerance``. A column without any
    value is filled with 0, and so are all columns of an empty table.
    """
    columns = list(columns or numeric_columns(df))
    clean = df.select(*[present(df, c).alias(c) for c in columns])
    facts = clean.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    starts = {c: facts[f"m{i}"] if facts[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}
    scales = {c: facts[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
    gaps = sorted((i for i in range(len(columns)) if 0 < facts[f"n{i}"] < facts["n"]), key=lambda i: facts["n"] - facts[f"n{i}"])
    if not gaps:
        return ChainedFill(tuple(columns), starts)
    moments = _Moments(clean, columns, starts, scales)
    done: list[tuple[int, np.ndarray]] = []
    steps: list[tuple[str, float, tuple[float, ...]]] = []
    previous: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        moved = 0.0
        for target in gaps:
            gram = moments.gram(target, done)
            others = [i for i in range(len(columns)) if i != target]
            at = [i + 1 for i in others]
            n, sz, sy = gram[0, 0], gram[0, at], gram[0, target + 1]
            centred = gram[np.ix_(at, at)] - np.outer(sz, sz) / n + ridge * np.eye(len(at))
            beta = np.linalg.lstsq(centred, gram[at, target + 1] - sz * sy / n, rcond=None)[0]
            alpha = sy / n - float(beta @ (sz / n))
            row = np.zeros(len(columns) + 1)
            row[0], row[at] = alpha, beta
            moments.apply(target, row)
            done.append((target, row))
            name = columns[target]
            weights = tuple(float(b * scales[name] / scales[columns[i]]) for b, i in zip(beta, others))
            steps.append((name, float(starts[name] + scales[name] * alpha - sum(w * starts[columns[i]] for w, i in zip(weights, others))), weights))
            now = np.concatenate(([alpha], beta))
            moved = max(moved, float(np.abs(now - previous[target]).max()) if target in previous else 1.0)
            previous[target] = now
        if moved < tolerance:
            break
    return ChainedFill(tuple(columns), starts, tuple(steps))
