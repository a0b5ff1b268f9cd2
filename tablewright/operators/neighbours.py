"""Exact nearest-neighbour imputation over balls of donors with distance bounds.

Distinct donor rows are dealt to balls by a tree that is grown on a bounded sample; the tree only
places rows, it never decides who is near. Of each ball the range of every column over all its
donors is known, which bounds the distance of a row to any donor inside. A row looks into the
ball of least bound first; its k-th distance there rules out most others, and it visits the rest.
A heavy ball is searched in blocks of donors, and what rows find in blocks and balls is merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.chained import present
from tablewright.operators.lookup import LookupTable
from tablewright.operators.schema import numeric_columns
from tablewright.session import hold, scratch_path
from tablewright.sources.stored_plans import storable

#: Donor rows that grow the tree, its most balls, and the donors of one ball while it has fewer.
#: They place rows and never change a result.
SAMPLE_ROWS = 20_000
MOST_BALLS = 2_048
BALL_ROWS = 2_048
#: Donors and asking rows that meet in one task at a time.
BLOCK_ROWS = 8_192
ASKING_ROWS = 50_000


def _row_key(columns: Sequence[str]) -> Column:
    """Identity of a row's values, missing ones included."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in columns]), 256)


def _any_missing(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])


def _values(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`") for c in columns]).alias("x")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equally long lists as a matrix, NaN where a value is missing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


@storable
@dataclass(frozen=True)
class BallTree:
    """Splits by one column each: missing values, values up to a cut, values above it.

    ``column`` is -1 for a ball, whose number is then in ``cut``; ``ways`` holds the three next places.
    """

    column: np.ndarray
    cut: np.ndarray
    ways: np.ndarray

    @property
    def balls(self) -> int:
        return int((self.column < 0).sum())

    def places(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.column[at] >= 0)):
            here = at[open_]
            v = x[open_, self.column[here]]
            with np.errstate(invalid="ignore"):
                way = np.where(np.isnan(v), 0, np.where(v <= self.cut[here], 1, 2))
            at[open_] = self.ways[here, way]
        return self.cut[at].astype(np.int64)


def grow(sample: np.ndarray, most: int) -> BallTree:
    """Halve the fullest ball at the middle of its widest column until there are ``most`` of them."""
    column, cut, ways = [-1], [0.0], [[0, 0, 0]]
    open_, balls = [(0, np.arange(len(sample)))], 1
    while open_ and balls + 2 <= most:
        open_.sort(key=lambda e: len(e[1]))
        at, rows = open_.pop()
        if len(rows) < 4:
            break
        x = sample[rows]
        with np.errstate(invalid="ignore"):
            gone = np.isnan(x).mean(0)
            spread = np.where(gone < 1, np.nanmax(np.where(np.isnan(x), -np.inf, x), 0) - np.nanmin(np.where(np.isnan(x), np.inf, x), 0), -1.0)
        mixed = np.flatnonzero((gone > 0) & (gone < 1))
        c = int(mixed[np.argmax(np.minimum(gone, 1 - gone)[mixed])]) if len(mixed) else int(np.argmax(spread))
        if not len(mixed) and spread[c] <= 0:
            continue
        v = np.sort(x[~np.isnan(x[:, c]), c])
        middle = v[(len(v) - 1) // 2]
        if middle == v[-1]:                                               # something has to lie above the cut
            lower = v[v < middle]
            middle = lower[-1] if len(lower) else middle
        column[at], cut[at] = c, float(middle)
        parts = [np.isnan(x[:, c]), x[:, c] <= middle, x[:, c] > middle]
        for way, part in enumerate(parts):
            ways[at][way] = len(column)
            open_.append((len(column), rows[part]))
            column.append(-1)
            cut.append(0.0)
            ways.append([0, 0, 0])
        balls += 2
    tree_column = np.array(column, np.int64)
    numbered = np.array(cut)
    numbered[tree_column < 0] = np.arange(int((tree_column < 0).sum()))
    return BallTree(tree_column, numbered, np.array(ways, np.int64))


@storable
@dataclass(frozen=True)
class Balls:
    """Range of every column over all donors of each ball, and how many have it."""

    low: np.ndarray
    high: np.ndarray
    known: np.ndarray
    size: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least possible distance of each row to any donor of each ball, infinite without a shared column.

        Donors may lack columns that not all of a ball have; the bound takes those for which it is
        least: the smallest gaps for as long as they lower the mean.
        """
        asked = ~np.isnan(x)
        gap = np.maximum(0.0, np.maximum(self.low[None] - x[:, None], x[:, None] - self.high[None]))
        all_have = (self.known == self.size[:, None])[None] & asked[:, None]
        some_have = ((self.known > 0) & (self.known < self.size[:, None]))[None] & asked[:, None]
        square = np.where(all_have | some_have, gap * gap, 0.0)
        sure, n_sure = np.where(all_have, square, 0.0).sum(2), all_have.sum(2)
        more = np.sort(np.where(some_have, square, np.inf), axis=2)
        best = np.where(n_sure > 0, sure / np.maximum(n_sure, 1), np.inf)
        total, n = sure.copy(), n_sure.astype(float)
        for k in range(x.shape[1]):
            step = more[:, :, k]
            total, n = total + step, n + 1
            best = np.minimum(best, np.where(np.isfinite(step), total / n, np.inf))
        return best * x.shape[1]

    def giving(self, target: int) -> np.ndarray:
        return self.known[:, target] > 0


def nearest(asking: np.ndarray, donors: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, target column, squared distances, donor rows) of each gap: the k nearest, by distance, then value."""
    columns = asking.shape[1]
    known = ~np.isnan(donors)
    step = max(1, 2_000_000 // max(1, len(donors)))
    for a in range(0, len(asking), step):
        x = asking[a:a + step]
        have = ~np.isnan(x)
        total, shared = np.zeros((len(x), len(donors))), np.zeros((len(x), len(donors)))
        for c in range(columns):
            both = have[:, c, None] & known[None, :, c]
            gap = np.where(both, np.where(have[:, c], x[:, c], 0.0)[:, None] - np.where(known[:, c], donors[:, c], 0.0)[None], 0.0)
            total += gap * gap
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(shared > 0, (columns / shared) * total, np.inf)
        for i in range(len(x)):
            for target in np.flatnonzero(~have[i]):
                d = np.where(known[:, target], distance[i], np.inf)
                far = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero(d <= far if np.isfinite(far) else np.isfinite(d))
                order = near[np.lexsort((donors[near, target], d[near]))]
                held = np.concatenate(([0], np.cumsum(weights[order])[:-1])) if len(order) else np.zeros(0)
                order = order[held < k]
                if len(order):
                    yield a + i, int(target), d[order], order


@storable
@dataclass(frozen=True)
class NeighbourFill:
    """Mean of the k nearest donors by distance over the values both rows have.

    The squared distance over the shared columns is scaled by (columns / shared columns).
    Equal rows are one donor with a weight, so copies cost nothing. Among donors at one
    distance the smaller donated value comes first. A gap without any donor that shares a column
    gets the column's mean; a column without any value stays missing.
    """

    donors: DataFrame            # ball, block, x (values), n (rows that have them)
    columns: tuple[str, ...]
    k: int
    tree: BallTree
    balls: Balls
    blocks: tuple[int, ...]      # blocks of each ball
    fallback: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        columns = list(self.columns)
        clean = df.select(*[present(df, c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
        rows = hold(clean.where(_any_missing(columns)).select(_row_key(columns).alias("key"), _values(columns))
                    .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")))
        fills = self.fills(rows.select("key", "x"))
        wide = fills.groupBy("key").agg(*[
            F.max(F.when(F.col("target") == i, F.col("fill"))).alias(f"fill{i}") for i in range(len(columns))])
        table = LookupTable.build(rows.select("key", "n").join(wide, "key"))
        joined = table.join(clean.withColumn("_row", F.when(_any_missing(columns), _row_key(columns))), "_row", [f"fill{i}" for i in range(len(columns))], "_")
        return joined.select(*[
            F.coalesce(F.col(f"`{c}`"), F.col(f"_fill{columns.index(c)}"), F.lit(self.fallback[c])).alias(c)
            if c in columns else F.col(f"`{c}`") for c in df.columns])

    def fills(self, rows: DataFrame) -> DataFrame:
        """(key, target, fill) for distinct rows ``(key, x)``."""
        first = self._merged(self._found(self._visits(rows.withColumn("far", F.lit(None).cast("array<double>")), True)))
        held = hold(first)
        limits = held.groupBy("key", "target").agg(F.sum("take").alias("w"), F.max("d2").alias("far")).where(F.col("w") >= self.k)
        targets = F.transform(F.sequence(F.lit(0), F.lit(len(self.columns) - 1)), lambda i: F.col("held")[i])
        known = limits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("target", "far"))).alias("held")).select("key", targets.alias("far"))
        later = self._found(self._visits(rows.join(known, "key", "left"), False))
        best = self._merged(held.select("key", "target", "d2", "value", "n").unionByName(later))
        return best.groupBy("key", "target").agg((F.sum(F.col("value") * F.col("take")) / F.sum("take")).alias("fill"))

    def _visits(self, rows: DataFrame, first: bool) -> DataFrame:
        """(ball, key, x): balls that each row looks into, first one by one, then all that its limits leave.

        ``far`` holds the k-th distance found for each column; without one, any ball may hold donors.
        """
        width, balls, columns = len(self.columns), self.balls, range(len(self.columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    keys, x = part.column(0).to_pylist(), _matrix(part.column(1), width)
                    far = part.column(2).to_pylist()
                    bound = balls.bounds(x)
                    row, ball = [], []
                    for i in range(len(keys)):
                        targets = [t for t in columns if np.isnan(x[i, t])]
                        start = {int(np.argmin(np.where(balls.giving(t), bound[i], np.inf))) for t in targets}
                        if first:
                            visit = start
                        else:
                            limit = [(far[i] or [None] * width)[t] for t in targets]
                            wanted = np.zeros(len(bound[i]), bool)
                            for t, most in zip(targets, limit):
                                # A hair's breadth more, as bound and distance are rounded apart.
                                wanted |= balls.giving(t) & np.isfinite(bound[i]) & (bound[i] <= (np.inf if most is None else most * (1 + 1e-9) + 1e-300))
                            visit = set(np.flatnonzero(wanted).tolist()) - start
                        row += [i] * len(visit)
                        ball += visit
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ball, pa.int32()), part.column(0).take(at), part.column(1).take(at)], ["ball", "key", "x"])

        return rows.select("key", "x", "far").mapInArrow(run, "ball int, key string, x array<double>")

    def _found(self, visits: DataFrame) -> DataFrame:
        """(key, target, d2, value, n): nearest donors of each visit; visits and donors meet in bounded cells."""
        k, width = self.k, len(self.columns)
        path = scratch_path(visits.sparkSession, "visits")
        visits.write.parquet(path)
        visits = visits.sparkSession.read.schema(visits.schema).parquet(path)
        counts = visits.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / ASKING_ROWS).cast("int").alias("chunks"))      # a row for each ball
        chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
        blocks = F.get(F.array(*[F.lit(b) for b in self.blocks]), F.col("ball"))
        asking = visits.join(F.broadcast(counts), "ball").select(
            "ball", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), chunk.alias("chunk"), "key", "x")
        giving = self.donors.join(F.broadcast(counts), "ball").select("ball", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "x", "n")

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("key", "target", "d2", "value", "n")}
            if left.num_rows and right.num_rows:
                keys, donors, weights = left.column("key").to_pylist(), _matrix(right.column("x"), width), right.column("n").to_numpy()
                for i, target, d2, at in nearest(_matrix(left.column("x"), width), donors, weights, k):
                    out["key"] += [keys[i]] * len(at)
                    out["target"] += [target] * len(at)
                    out["d2"] += d2.tolist()
                    out["value"] += donors[at, target].tolist()
                    out["n"] += weights[at].tolist()
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

        by = ["ball", "block", "chunk"]
        return asking.groupBy(*by).cogroup(giving.groupBy(*by)).applyInArrow(search, "key string, target int, d2 double, value double, n bigint")

    def _merged(self, found: DataFrame) -> DataFrame:
        """The first k donors by weight of each gap, of at most k from each block."""
        order = Window.partitionBy("key", "target").orderBy("d2", "value")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return found.withColumn("before", before).where(F.col("before") < self.k).withColumn(
            "take", F.least(F.col("n"), self.k - F.col("before"))).drop("before")


def fit_neighbours(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> NeighbourFill:
    """Every row of the fitted table is a donor for the columns it has; rows without any value are none."""
    columns = list(columns or numeric_columns(df))
    spark, width = df.sparkSession, len(columns)
    clean = df.select(*[present(df, c).alias(c) for c in columns])
    distinct = clean.select(_values(columns)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "donors")
    distinct.where(F.exists("x", lambda v: v.isNotNull())).write.parquet(path)
    donors = spark.read.schema("x array<double>, n bigint").parquet(path)
    rows = donors.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    picked = donors.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(share * (1 << 20))).select("x").limit(2 * SAMPLE_ROWS).toArrow()
    tree = grow(_matrix(picked.column("x"), width) if picked.num_rows else np.zeros((0, width)), min(MOST_BALLS, max(1, rows // BALL_ROWS)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball = tree.places(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(ball, pa.int32()), batch.column(0), batch.column(1)], ["ball", "x", "n"])

    in_balls = hold(donors.mapInArrow(placed, "ball int, x array<double>, n bigint"))
    x = [F.get("x", F.lit(i)) for i in range(width)]
    facts = in_balls.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), *[
        a.alias(f"{name}{i}") for i in range(width) for name, a in (("low", F.min(x[i])), ("high", F.max(x[i])), ("known", F.count(x[i])))]).collect()
    low, high = np.full((tree.balls, width), np.inf), np.full((tree.balls, width), -np.inf)
    known, size = np.zeros((tree.balls, width), np.int64), np.zeros(tree.balls, np.int64)
    for r in facts:
        b, size[r["ball"]] = r["ball"], r["size"]
        for i in range(width):
            known[b, i] = r[f"known{i}"]
            if r[f"known{i}"]:
                low[b, i], high[b, i] = r[f"low{i}"], r[f"high{i}"]
    blocks = np.maximum(1, -(-size // BLOCK_ROWS))
    of_ball = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("ball"))
    block = F.pmod(F.xxhash64("x"), of_ball).cast("int")
    means = clean.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return NeighbourFill(in_balls.select("ball", block.alias("block"), "x", "n"), tuple(columns), k, tree, Balls(low, high, known, size),
                         tuple(blocks.tolist()), {c: means[f"m{i}"] for i, c in enumerate(columns)})
