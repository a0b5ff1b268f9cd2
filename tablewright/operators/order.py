"""Exact order statistics, cuts and running sums without a one-task sort.

* ``select_ranks`` finds exact order statistics by refining histograms over integers or the
  order-preserving bit pattern of doubles: every pass settles 13 bits in one scan; tasks
  count Arrow batches and only counters are shuffled.
* ``rank_cuts`` does the same for a uniform hash, so a table can be cut at an exact
  row count by a plain column expression.
* ``running_sums`` range-partitions pre-aggregated distinct values and adds the totals
  of the partitions before; no partition ever holds a whole group.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import HASH_BITS
from tablewright.session import cut_lineage, hold, spread

#: Bits of the value settled in a pass: five passes for any data, while the counters fit the budget.
_PASS_BITS = 13
_COUNTER_BUDGET = 200_000
_PREFIX_BITS = 12
_SMALL_BUCKET = 1_000
_LAST = (1 << 63) - 1
_MAGNITUDE = np.int64(_LAST)
#: Bit pattern of the positive quiet NaN.
_NAN_KEY = np.int64(0x7FF8 << 48)


def clean_number(column: Column, data_type: T.DataType) -> Column:
    """Doubles with NaN read as missing; integers keep their exactness."""
    if isinstance(data_type, T.IntegralType):
        return column.cast("bigint")
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Interval:
    low: int
    high: int
    below: int
    ranks: list[int]


@dataclass(frozen=True)
class Ranked:
    """One order statistic: its value and how many values are strictly smaller."""

    value: float
    below: int


def column_extent(df: DataFrame, values: Mapping[str, Column], whole: Mapping[str, bool] | None = None) -> dict[str, tuple]:
    """(count, min, max) of each numeric expression in one job; a task sends one row for each expression."""
    names = list(values)
    whole = whole or whole_expressions(df, values)
    kinds = [whole[n] for n in names]

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for i, kind in enumerate(kinds):
                keys = _keys(batch.column(i), kind)
                if len(keys):
                    n, low, high = held.get(i, (0, int(keys[0]), int(keys[0])))
                    held[i] = n + len(keys), min(low, int(keys.min())), max(high, int(keys.max()))
        yield _int_batch(["col", "n", "lo", "hi"], [[i, *e] for i, e in held.items()])

    found = (
        _picked(df, values, names, kinds).mapInArrow(extents, "col bigint, n bigint, lo bigint, hi bigint").groupBy("col")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    )
    rows = {r["col"]: r for r in found}
    result = {}
    for i, name in enumerate(names):
        r = rows.get(i)
        if r is None:
            result[name] = (0, None, None)
        else:
            result[name] = (r["n"], *[k if kinds[i] else _key_double(k) for k in (r["lo"], r["hi"])])
    return result


def whole_expressions(df: DataFrame, values: Mapping[str, Column]) -> dict[str, bool]:
    """Which expressions are integers (kept exact) rather than doubles."""
    schema = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values.values())]).schema
    return {name: isinstance(f.dataType, T.IntegralType) for name, f in zip(values, schema.fields, strict=True)}


def _picked(df: DataFrame, values: Mapping[str, Column], names: Sequence[str], whole: Sequence[bool]) -> DataFrame:
    """One column per expression, as doubles or BIGINT."""
    return spread(df.select(*[values[n].cast("bigint" if w else "double").alias(f"v{i}") for i, (n, w) in enumerate(zip(names, whole, strict=True))]))


def _keys(column: pa.Array, whole: bool) -> np.ndarray:
    """Known values of a column as order-preserving BIGINTs: integers as they are, doubles by sign and bit pattern.

    Both zeros are 0; NaN comes after everything else.
    """
    known = column.drop_null().to_numpy(zero_copy_only=False)
    if whole:
        return known.astype(np.int64)
    bits = known.astype(float).view(np.int64)
    keys = np.where(bits < 0, -(bits & _MAGNITUDE), bits)
    return np.where(np.isnan(known), _NAN_KEY, keys)


def _int_batch(names: list[str], rows: Sequence[Sequence[int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def select_ranks(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    extent: Mapping[str, tuple] | None = None,
) -> dict[str, dict[int, Ranked]]:
    """Exact order statistics (0-based ranks, nulls ignored) of numeric expressions."""
    extent = extent or column_extent(df, {name: values[name] for name in ranks})
    found: dict[str, dict[int, Ranked]] = {name: {} for name in ranks}
    open_parts: dict[str, list[_Interval]] = {}
    for name, wanted in ranks.items():
        count, low, high = extent[name]
        wanted = sorted({r for r in wanted if 0 <= r < count})
        if not wanted:
            continue
        if low == high:
            found[name].update({r: Ranked(low, 0) for r in wanted})
        else:
            open_parts[name] = [_Interval(low, high, 0, wanted)]

    if not open_parts:
        return found
    names = list(open_parts)
    whole = [isinstance(open_parts[name][0].low, int) for name in names]
    for position, name in enumerate(names):
        for part in open_parts[name]:
            part.low, part.high = (_number_key(x, whole[position]) for x in (part.low, part.high))
    picked = _picked(df, values, names, whole)
    while open_parts:
        n_parts = sum(len(parts) for parts in open_parts.values())
        bits = max(6, min(_PASS_BITS, (_COUNTER_BUDGET // n_parts).bit_length() - 1))
        histogram: dict[tuple[int, int], list] = {}
        for row in _histogram(picked, names, open_parts, bits):
            histogram.setdefault((row["col"], row["part"]), []).append(row)
        next_parts: dict[str, list[_Interval]] = {}
        for position, name in enumerate(names):
            for i, interval in enumerate(open_parts.get(name, [])):
                below = interval.below
                pending = list(interval.ranks)
                for row in sorted(histogram[(position, i)], key=lambda r: r["lo"]):
                    inside = [r for r in pending if r < below + row["n"]]
                    pending = pending[len(inside):]
                    if inside and row["lo"] == row["hi"]:
                        value = row["lo"] if whole[position] else _key_double(row["lo"])
                        found[name].update({r: Ranked(value, below) for r in inside})
                    elif inside:
                        next_parts.setdefault(name, []).append(_Interval(row["lo"], row["hi"], below, inside))
                    below += row["n"]
        open_parts = next_parts
    return found


def _number_key(x: float | int, whole: bool) -> int:
    if whole:
        return int(x)
    key = struct.unpack("<q", struct.pack("<d", abs(float(x))))[0]
    return -key if x < 0 else key


def _key_double(key: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def _histogram(picked: DataFrame, names: list[str], parts: Mapping[str, list[_Interval]], bits: int) -> list:
    """Counts and extent per (column, interval, bucket); a bucket is 1/2**bits of its interval or less.

    Tasks count whole Arrow batches; only their counters are shuffled.
    """
    # Intervals of a column are disjoint and ascending: a key belongs to the last one starting at or below.
    plans = []
    for position, name in enumerate(names):
        if intervals := parts.get(name):
            shifts = [max(0, (p.high - p.low).bit_length() - bits) for p in intervals]
            first = [p.low >> s for p, s in zip(intervals, shifts)]
            sizes = [(p.high >> s) - f + 1 for p, s, f in zip(intervals, shifts, first)]
            starts = np.cumsum([0, *sizes])
            plans.append((position, isinstance(picked.schema[position].dataType, T.LongType), np.array([p.low for p in intervals], np.int64),
                          np.array([p.high for p in intervals], np.int64), np.array(shifts, np.int64), np.array(first, np.int64), starts))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(starts[-1], np.int64), np.full(starts[-1], _LAST), np.full(starts[-1], -_LAST - 1)) for *_, starts in plans]
        for batch in batches:
            for (position, whole, low, high, shifts, first, starts), (n, lo, hi) in zip(plans, held):
                keys = _keys(batch.column(position), whole)
                part = np.searchsorted(low, keys, side="right") - 1
                inside = (part >= 0) & (keys <= high[part])
                keys, part = keys[inside], part[inside]
                cell = starts[part] + ((keys >> shifts[part]) - first[part])
                n += np.bincount(cell, minlength=len(n))
                np.minimum.at(lo, cell, keys)
                np.maximum.at(hi, cell, keys)
        for (position, _, low, _, _, first, starts), (n, lo, hi) in zip(plans, held):
            cell = np.flatnonzero(n)
            part = np.searchsorted(starts, cell, side="right") - 1
            yield pa.RecordBatch.from_pydict({
                "col": np.full(len(cell), position), "part": part, "bucket": cell - starts[part] + first[part], "n": n[cell], "lo": lo[cell], "hi": hi[cell]})

    return (
        picked.mapInArrow(counted, "col bigint, part bigint, bucket bigint, n bigint, lo bigint, hi bigint")
        .groupBy("col", "part", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    )


def quantiles(
    df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles (the usual "type 7") of every expression."""
    extent = column_extent(df, values)
    wanted: dict[str, list[int]] = {}
    for name, (count, _, _) in extent.items():
        if count:
            wanted[name] = [
                r for p in probabilities
                for r in (math.floor(p * (count - 1)), math.ceil(p * (count - 1)))
            ]
    found = select_ranks(df, values, wanted, extent)
    result: dict[str, list[float | None]] = {}
    for name, (count, _, _) in extent.items():
        if not count:
            result[name] = [None] * len(probabilities)
            continue
        row = []
        for p in probabilities:
            position = p * (count - 1)
            low = float(found[name][math.floor(position)].value)
            high = float(found[name][math.ceil(position)].value)
            row.append(low + (high - low) * (position - math.floor(position)))
        result[name] = row
    return result


@dataclass(frozen=True)
class Cut:
    """The last (hash, key) that still belongs to the first ``rank`` rows; None = no row."""

    hash_value: int | None
    key: object


def before_cut(hash_column: Column, key: Column, cut: Cut) -> Column:
    """True for the rows at or before the cut."""
    if cut.hash_value is None:
        return F.lit(False)
    at = F.lit(cut.hash_value).cast("bigint")
    return (hash_column < at) | ((hash_column == at) & (key <= F.lit(cut.key)))


def rank_cuts(
    df: DataFrame,
    hash_column: Column,
    key: str,
    sizes: Callable[[object, int], list[int]],
    label: str | None = None,
) -> dict[object, list[Cut]]:
    """Cuts of the hash order at exact row counts, per label value.

    ``sizes(label, n)`` returns the increasing row counts to cut at. The hash is
    uniform, so each pass divides the undecided rows by ``2**12``; the last pass
    reads only the few rows that share the boundary prefixes.
    """
    label_column = F.col(label) if label else F.lit(None).cast("string")
    hashed = df.select(label_column.alias("_label"), hash_column.alias("_h"), F.col(key).alias("_key"))
    shift = HASH_BITS - _PREFIX_BITS
    first = (
        hashed.groupBy("_label", F.shiftright("_h", shift).alias("_p")).count().collect()
    )
    counts: dict[object, dict[int, int]] = {}
    for row in first:
        counts.setdefault(row["_label"], {})[row["_p"]] = row["count"]

    cuts: dict[object, list[Cut | None]] = {}
    pending: dict[tuple, int] = {}      # (label, position, prefix) -> remaining rank
    for value, prefixes in counts.items():
        targets = sizes(value, sum(prefixes.values()))
        cuts[value] = [None] * len(targets)
        for position, target in enumerate(targets):
            if target <= 0:
                cuts[value][position] = Cut(None, None)
                continue
            seen = 0
            for prefix in sorted(prefixes):
                if seen + prefixes[prefix] >= target:
                    pending[(value, position, prefix)] = target - seen
                    break
                seen += prefixes[prefix]
    sizes_of = {(v, p): n for v, prefixes in counts.items() for p, n in prefixes.items()}

    while pending:
        wanted = {(value, prefix) for value, _, prefix in pending}
        largest = max(sizes_of[w] for w in wanted)
        prefix_column = F.shiftright("_h", shift)
        rows_in = hashed.where(prefix_column.isin(sorted({p for _, p in wanted})))
        if shift == 0 and largest > _SMALL_BUCKET:
            raise ValueError(f"column {key!r} must identify rows: many rows share one value")
        if largest <= _SMALL_BUCKET:
            ordered: dict[tuple, list] = {}
            for row in rows_in.select("_label", "_h", "_key").collect():
                ordered.setdefault((row["_label"], row["_h"] >> shift), []).append((row["_h"], row["_key"]))
            for rows in ordered.values():
                rows.sort()
            for (value, position, prefix), rank in pending.items():
                cuts[value][position] = Cut(*ordered[(value, prefix)][rank - 1])
            break
        next_shift = max(0, shift - _PREFIX_BITS)
        finer: dict[tuple, dict[int, int]] = {}
        for row in (
            rows_in.groupBy("_label", F.shiftright("_h", next_shift).alias("_p")).count().collect()
        ):
            parent = row["_p"] >> (shift - next_shift)
            finer.setdefault((row["_label"], parent), {})[row["_p"]] = row["count"]
        next_pending: dict[tuple, int] = {}
        sizes_of = {}
        for (value, position, prefix), rank in pending.items():
            seen = 0
            for child in sorted(finer[(value, prefix)]):
                n = finer[(value, prefix)][child]
                if seen + n >= rank:
                    next_pending[(value, position, child)] = rank - seen
                    sizes_of[(value, child)] = n
                    break
                seen += n
        pending, shift = next_pending, next_shift
    return cuts


def running_sums(
    counts: DataFrame, by: Sequence[str], order: str, sums: Sequence[str]
) -> DataFrame:
    """Inclusive running totals ``run_<c>`` over ``order`` within ``by``.

    ``counts`` holds one row per distinct (by, order): pre-aggregate first, so that
    repeated values cannot make a partition heavy. Each range partition is summed on
    its own; the totals of the partitions before are added.
    """
    by = list(by)
    # Range cuts are sampled anew whenever a partition is computed again: fix them in the shared folder.
    ranged = cut_lineage(counts.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *by,
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    if not by:
        joined = ranged.join(offsets, "_range")
    else:
        condition = ranged["_range"] == offsets["_range"]
        for column in by:
            condition = condition & ranged[column].eqNullSafe(offsets[column])
        joined = ranged.join(offsets, condition).select(
            ranged["*"], *[offsets[f"_o_{c}"] for c in sums]
        )
    inner = (
        Window.partitionBy("_range", *by).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = [(F.sum(c).over(inner) + F.col(f"_o_{c}")).alias(f"run_{c}") for c in sums]
    return joined.select(*counts.columns, *running)
