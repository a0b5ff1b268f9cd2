"""Leak-free splits and folds, decided by a seeded hash or by time.

Every operator fits a few cut values and then labels rows with one column expression:
rows are never sorted or shuffled, and the sizes are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import seeded_hash
from tablewright.operators.order import Cut, before_cut, column_extent, rank_cuts, select_ranks
from tablewright.session import hold

STRATEGIES = ("random", "stratified", "time", "group")


def split_sizes(n: int, test: float, val: float) -> tuple[int, int]:
    """Row counts of the test and validation parts; shares are rounded up."""
    n_test = math.ceil(_tidy(n * test))
    n_val = math.ceil(_tidy((n - n_test) * val / (1.0 - test))) if val > 0 else 0
    return n_test, n_val


def class_sizes(n: int, test: float, val: float) -> tuple[int, int]:
    """Row counts inside one class; shares are rounded half up."""
    n_test = math.floor(_tidy(n * test) + 0.5)
    n_val = math.floor(_tidy((n - n_test) * val / (1.0 - test)) + 0.5) if val > 0 else 0
    return n_test, n_val


def _tidy(x: float) -> float:
    """Drop the last binary digits so that 0.2 * 10 counts as exactly 2."""
    return round(x, 9)


def _three_way(h: Column, key: Column, test: Cut, val: Cut) -> Column:
    return (
        F.when(before_cut(h, key, test), "test")
        .when(before_cut(h, key, val), "val")
        .otherwise("train")
    )


def random_split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact-size random split; the same rows for any partitioning."""
    h = seeded_hash([key], seed)

    def sizes(_, n):
        n_test, n_val = split_sizes(n, test, val)
        return [n_test, n_test + n_val]

    cuts = rank_cuts(df, h, key, sizes).get(None, [Cut(None, None)] * 2)
    return df.withColumn("split", _three_way(h, F.col(key), *cuts))


def _by_label(df: DataFrame, label: str, h: Column, key: str, cuts: dict[object, list[Cut]],
              names: list) -> Column:
    """Name of the section a row falls into, given the cuts of its class."""
    # The cuts of all classes are one map literal; its size is that of the class list.
    rows = [(value, class_cuts) for value, class_cuts in cuts.items() if value is not None]
    result = F.lit(names[-1])
    if rows:
        each = F.get(F.array(*[F.array(*[_cut_literal(c) for c in class_cuts]) for _, class_cuts in rows]),
                     F.array_position(F.array(*[F.lit(v) for v, _ in rows]), F.col(label)).cast("int") - 1)
        for i in reversed(range(len(names) - 1)):
            cut = F.get(each, F.lit(i))
            before = (h < cut["h"]) | ((h == cut["h"]) & (F.col(key) <= cut["key"]))
            result = F.when(F.coalesce(before, F.lit(False)), F.lit(names[i])).otherwise(result)
    if None in cuts:
        section = F.lit(names[-1])
        for cut, name in reversed(list(zip(cuts[None], names, strict=False))):
            section = F.when(before_cut(h, F.col(key), cut), F.lit(name)).otherwise(section)
        result = F.when(F.col(label).isNull(), section).otherwise(result)
    return result


def _cut_literal(cut: Cut) -> Column:
    return F.struct(F.lit(cut.hash_value).cast("bigint").alias("h"), F.lit(cut.key).alias("key"))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, val: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """The same proportions inside every class of the label, however many there are."""
    h = seeded_hash([key], seed)

    def sizes(_, n):
        n_test, n_val = class_sizes(n, test, val)
        return [n_test, n_test + n_val]

    cuts = rank_cuts(df, h, key, sizes, label)
    return df.withColumn("split", _by_label(df, label, h, key, cuts, ["test", "val", "train"]))


def _order_number(df: DataFrame, column: str) -> Column:
    data_type = df.schema[column].dataType
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(data_type, T.IntegralType):
        return F.col(column).cast("bigint")
    return F.col(column).cast("double")


def time_split(df: DataFrame, order: str, key: str, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Oldest rows train, newest test; rows without a time count as newest.

    Ties in time are broken by the integer key. The boundary rows are found by
    histogram refinement over the time and then over the keys of the boundary time.
    """
    time = _order_number(df, order)
    number = F.col(key).cast("bigint")
    rows = df.select(time.alias("_t"), number.alias("_k"))
    n = rows.count()
    n_test, n_val = int(_tidy(n * test)), int(_tidy(n * val))
    ends = {"train": n - n_test - n_val, "val": n - n_test}
    known = column_extent(rows, {"_t": F.col("_t")})
    n_known = known["_t"][0]

    def upto(end: int) -> Column:
        """True for the first ``end`` rows in (time, key) order, nulls last."""
        if end <= 0:
            return F.lit(False)
        if end >= n:
            return F.lit(True)
        if end <= n_known:
            at = select_ranks(rows, {"_t": F.col("_t")}, {"_t": [end - 1]}, known)["_t"][end - 1]
            earlier, same, below = time < F.lit(at.value), time == F.lit(at.value), at.below
        else:
            earlier, same, below = time.isNotNull(), time.isNull(), n_known
        inside = df.select(F.when(same, number).alias("_k"))
        rank = end - 1 - below
        last = select_ranks(inside, {"_k": F.col("_k")}, {"_k": [rank]})["_k"][rank].value
        return F.coalesce(earlier, F.lit(False)) | (F.coalesce(same, F.lit(False)) & (number <= F.lit(last)))

    return df.withColumn(
        "split",
        F.when(upto(ends["train"]), "train").when(upto(ends["val"]), "val").otherwise("test"),
    )


def group_split(df: DataFrame, group: str | None, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """No group on both sides; the share is of groups. Without a group: a random split.

    The side is a function of the group's hash alone, so labelling needs no join.
    """
    if group is None:
        return random_split(df, key, test, 0.0, seed)
    h = seeded_hash([group], seed)
    groups = hold(df.select(group).distinct())
    cuts = rank_cuts(groups, h, group, lambda _, n: [split_sizes(n, test, 0.0)[0]])
    groups.unpersist()
    cut = cuts.get(None, [Cut(None, None)])[0]
    return df.withColumn("split", F.when(before_cut(h, F.col(group), cut), "test").otherwise("train"))


def split_table(df: DataFrame, strategy: str, key: str, **options) -> DataFrame:
    """Dispatch by name; an unknown strategy is an error."""
    if strategy == "random":
        return random_split(df, key, **options)
    if strategy == "stratified":
        return stratified_split(df, key, **options)
    if strategy == "time":
        return time_split(df, key=key, **options)
    if strategy == "group":
        return group_split(df, key=key, **options)
    raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")


def _fold_ends(n: int, k: int) -> list[int]:
    """Row counts up to the end of folds 0..k-2; the first n mod k folds have one more."""
    return [(i + 1) * (n // k) + min(i + 1, n % k) for i in range(k - 1)]


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold ids 0..k-1 of nearly equal size."""
    h = seeded_hash([key], seed)
    cuts = rank_cuts(df, h, key, lambda _, n: _fold_ends(n, k)).get(None, [])
    fold = F.lit(k - 1)
    for i, cut in reversed(list(enumerate(cuts))):
        fold = F.when(before_cut(h, F.col(key), cut), i).otherwise(fold)
    return df.withColumn("fold", fold)


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold ids of nearly equal size inside every class."""
    h = seeded_hash([key], seed)
    cuts = rank_cuts(df, h, key, lambda _, n: _fold_ends(n, k), label)
    return df.withColumn("fold", _by_label(df, label, h, key, cuts, list(range(k))))
