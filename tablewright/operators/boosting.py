"""Gradient-boosted trees on histograms of binned features.

Rows are binned once into blocks of columns. Each round moves the margins by its last trees once
and holds the gradients of the rows it uses; a pass over them sums gradients for each node, feature
and bin, and the best split of each node follows. A level of all trees of a round (one for each
class) is one pass; leaf values follow from the splits' own sums, and the validation loss rides
along with the next round's first pass.

A table of a few blocks is grown in one task. Otherwise the blocks are dealt to the cores and a pass
is a job without a plan to optimise: few sums come to the driver as they are, many are added in one
shuffle and only the best splits come back. Blocks are written with their margins every few rounds,
so a lost executor costs the trees since then and the lineage never grows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tablewright.session import scratch_path
from tablewright.sources.stored_plans import drop_folder, storable

BLOCK_ROWS = 16_384
#: Most rounds between two writes of the margins; fewer where a core has many blocks, as a lost
#: executor repeats the trees since the last write.
WRITE_ROUNDS = 20
#: Bytes of blocks in a part (small files are read back whole), least rows of a round that are summed at once, and most bytes of sums that a
#: pass sends to the driver without adding them up first.
PART_BYTES = 24 << 20
WORK_ROWS = 65_536
SUM_BYTES = 64 << 20
#: Most blocks, and most rows times features and classes, of a table whose trees one task grows. A job
#: costs about 80 ms; one core passes over so many cells in about as long.
NEAR_BLOCKS = 16
NEAR_CELLS = 4_000_000
_MISSING = 0


@storable
@dataclass(frozen=True)
class BoostOptions:
    """``depth`` 0 is no limit, ``leaves`` 0 is no limit; ``symmetric`` trees split a whole level alike."""

    trees: int = 500
    rate: float = 0.05
    depth: int = 6
    leaves: int = 0
    row_share: float = 1.0
    column_share: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_hessian: float = 0.0
    symmetric: bool = False
    bins: int = 255
    patience: int = 50
    seed: int = 42


# Boosting presets.
PRESETS = {
    "xgboost": BoostOptions(trees=500, rate=0.05, depth=6, row_share=0.8, column_share=0.8, l2=1.0, min_hessian=1.0),
    "lightgbm": BoostOptions(trees=1000, rate=0.05, depth=0, leaves=31, row_share=0.8, column_share=0.8, l2=0.0, min_rows=20, min_hessian=1e-3),
    "catboost": BoostOptions(trees=1000, rate=0.05, depth=6, l2=3.0, symmetric=True),
}


@storable
@dataclass(frozen=True)
class Trees:
    """Nodes of many trees end to end; ``root`` holds each tree's first node, ``kind`` its class.

    A node with ``feature`` -1 is a leaf. ``cut`` is the largest value that goes left.
    """

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    root: np.ndarray
    kind: np.ndarray

    def margins(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of each row and class: (rows, classes)."""
        out = np.tile(base, (len(x), 1))
        used = np.flatnonzero(np.bincount(self.feature[self.feature >= 0], minlength=1))
        column, code = np.zeros(x.shape[1], np.int64), np.zeros(len(self.feature), np.int64)
        bins = np.empty((len(used), len(x)), np.uint16)
        for i, f in enumerate(used.tolist()):                   # a value's place among the cuts of its feature says all
            at = np.flatnonzero(self.feature == f)
            cuts, place = np.unique(self.cut[at], return_inverse=True)
            column[f], code[at] = i, 1 + place
            if len(cuts) > 65_533:
                bins = bins.astype(np.uint32)
            bins[i] = np.where(np.isnan(x[:, f]), _MISSING, 1 + np.searchsorted(cuts, x[:, f], side="left"))
        if bins.max(initial=0) < 256:
            bins = bins.astype(np.uint8)
        ends = self.root.tolist()[1:]
        if len(self.root):
            top, child = self.root[-1] + 1, np.maximum(self.left, self.right)
            while (last := child[self.root[-1]:top].max() + 1) > top:          # nodes of rounds cut off may follow
                top = last
            ends.append(int(top))
        for a, b, k in zip(self.root.tolist(), ends, self.kind.tolist()):
            feature = self.feature[a:b]
            tree = (np.where(feature >= 0, column[feature], -1), code[a:b], self.missing_left[a:b], self.left[a:b] - a, self.right[a:b] - a, self.value[a:b])
            out[:, k] += tree[5][_places(bins, tree, len(x))]
        return out


@storable
@dataclass(frozen=True)
class BoostedModel:
    """Fitted trees; transforms like a Spark ML model (features to prediction, probability)."""

    task: str
    n_features: int
    classes: int                 # 1: a number; 2: one margin; more: one margin each
    base: np.ndarray
    trees: Trees
    gains: np.ndarray
    curve: tuple[float, ...] = ()      # validation loss after each round
    best_round: int = 0
    options: BoostOptions = field(default_factory=BoostOptions)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (the name Spark ML models have)
        total = self.gains.sum()
        return DenseVector(self.gains / total if total > 0 else self.gains)

    @property
    def n_rounds(self) -> int:
        return len(self.trees.root) // len(self.base)

    def transform(self, df: DataFrame) -> DataFrame:
        trees, base, width = self.trees, self.base, self.n_features

        @pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack([np.asarray(v, float) for v in features])
            if x.shape[1] != width:
                raise ValueError(f"{width} features expected, {x.shape[1]} given")
            return pd.Series(list(trees.margins(x, base)))

        out = df.withColumn("_m", margins(vector_to_array("features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.get("_m", F.lit(0))).drop("_m")
        if self.classes <= 2:
            p = 1.0 / (1.0 + F.exp(-F.get("_m", F.lit(0))))
            out = out.withColumn("_p", F.array(1.0 - p, p))
        else:
            top = F.array_max("_m")
            out = out.withColumn("_e", F.transform("_m", lambda v: F.exp(v - top)))
            total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
            out = out.withColumn("_p", F.transform("_e", lambda v: v / total)).drop("_e")
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_m", "_p")

    def cut_to(self, rounds: int) -> "BoostedModel":
        """The model of the first rounds only."""
        k = len(self.base)
        return replace(self, trees=replace(self.trees, root=self.trees.root[:rounds * k], kind=self.trees.kind[:rounds * k]), best_round=rounds)


# --- growing ---------------------------------------------------------------------


class _Growing:
    """The trees of one round while they grow: nodes as lists, the frontier, all on bins."""

    def __init__(self, classes: int):
        self.nodes = [[_leaf()] for _ in range(classes)]

    def arrays(self, k: int) -> tuple[np.ndarray, ...]:
        n = self.nodes[k]
        return tuple(np.array([e[c] for e in n]) for c in ("feature", "bin", "missing_left", "left", "right", "value"))


def _leaf(value: float = 0.0, depth: int = 0) -> dict:
    return {"feature": -1, "bin": 0, "missing_left": True, "left": -1, "right": -1, "value": value, "depth": depth, "weight": 0.0, "gain": 0.0}


def _places(bins: np.ndarray, tree: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """The node each row of a block is in."""
    feature, cut, missing_left, left, right, _ = tree
    inner, bin_ = feature >= 0, np.arange(256 if bins.dtype == np.uint8 else 1 + int(bins.max(initial=0)))
    # The node that follows each node and bin; a leaf follows itself.
    go_left = np.where(bin_ == _MISSING, missing_left[:, None], bin_ <= cut[:, None])
    after = np.where(inner[:, None], np.where(go_left, left[:, None], right[:, None]), np.arange(len(feature))[:, None]).ravel()
    start, flat, row = np.where(inner, feature, 0) * n, bins.ravel(), np.arange(n)
    node, level = np.zeros(n, np.int64), np.zeros(1, np.int64)
    while len(level := level[inner[level]]):
        node = after.take(node * len(bin_) + flat.take(start.take(node) + row))
        level = np.concatenate([left[level], right[level]])
    return node


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(0.0, np.abs(g) - l1)


def best_splits(sums: np.ndarray, o: BoostOptions) -> np.ndarray:
    """For each node (rows of ``sums``: nodes, bins, 3 for gradient, hessian, rows) all gains: (nodes, 2, bins - 1).

    The second axis says whether missing values go left (1) or right (0), the last one which bin is the
    last to go left (all of them: missing values against the rest); impossible splits have minus infinity.
    """
    total = sums.sum(1)
    missing = sums[:, _MISSING]
    held = np.cumsum(sums[:, 1:], axis=1)
    gains = []
    for side in (0, 1):
        left = held + missing[:, None] * side
        right = total[:, None] - left
        ok = (left[..., 2] >= max(1, o.min_rows)) & (right[..., 2] >= max(1, o.min_rows)) & (left[..., 1] >= o.min_hessian) & (right[..., 1] >= o.min_hessian)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = sum(_shrunk(s[..., 0], o.l1) ** 2 / (s[..., 1] + o.l2) for s in (left, right))
            whole = _shrunk(total[:, 0], o.l1) ** 2 / (total[:, 1] + o.l2)
        gain = 0.5 * (score - whole[:, None]) - o.min_gain
        gains.append(np.where(ok & np.isfinite(gain), gain, -np.inf))
    return np.stack(gains, 1)


def _slopes(margin: np.ndarray, label: np.ndarray, regression: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and then hessians of each class, and each row's loss."""
    if regression:
        gap = margin[0] - label
        return np.stack([gap, np.ones_like(gap)]), gap * gap
    if len(margin) == 1:
        p = 1.0 / (1.0 + np.exp(-margin[0]))
        return np.stack([p - label, p * (1 - p)]), np.logaddexp(0.0, margin[0]) - label * margin[0]
    e = np.exp(margin - margin.max(0))
    p = e / e.sum(0)
    hit = label[None] == np.arange(len(margin))[:, None]
    return np.concatenate([p - hit, p * (1 - p)]), -np.log(np.maximum(1e-300, np.where(hit, p, 0).sum(0)))


class _Pass:
    """What tasks do with blocks (number, rows, bins, label, held, margin) and with the rows of a round
    (rows, bins of its features, gradients and hessians, validation loss, validation rows)."""

    def __init__(self, cuts: list[np.ndarray], classes: int, base: np.ndarray, o: BoostOptions):
        self.cuts, self.k, self.o, self.regression = cuts, len(base), o, classes == 1
        self.kind = np.uint8 if o.bins <= 255 else np.uint16

    def moved(self, block: tuple, trees: list[tuple]) -> tuple:
        """A block whose margins are moved by the trees of a round."""
        n = block[1]
        bins, margin = np.frombuffer(block[2], self.kind).reshape(-1, n), np.frombuffer(block[5]).reshape(self.k, n).copy()
        for c, tree in enumerate(trees):
            margin[c] += tree[5][_places(bins, tree, n)]
        return *block[:5], margin.tobytes()

    def used(self, blocks: Iterable[tuple], features: list[int], turn: int) -> Iterator[tuple]:
        """The rows that a round uses, some blocks together."""
        held_rows: list[tuple] = []
        for number, n, bins, label, held, margin in blocks:
            bins, label, held = np.frombuffer(bins, self.kind).reshape(-1, n), np.frombuffer(label), np.frombuffer(held, bool)
            gh, each = _slopes(np.frombuffer(margin).reshape(self.k, n), label, self.regression)
            take = ~held
            if self.o.row_share < 1:
                take &= np.random.Generator(np.random.PCG64([self.o.seed, turn, number])).random(n) < self.o.row_share
            pick = np.flatnonzero(take)
            held_rows.append((len(pick), bins[features][:, pick], gh[:, pick], float(each[held].sum()), int(held.sum())))
            if sum(r[0] for r in held_rows) >= WORK_ROWS:
                yield self._joined(held_rows)
                held_rows = []
        if held_rows:
            yield self._joined(held_rows)

    @staticmethod
    def _joined(rows: list[tuple]) -> tuple:
        n, bins, gh, loss, held = zip(*rows)
        return sum(n), np.concatenate(bins, 1).tobytes(), np.concatenate(gh, 1).tobytes(), sum(loss), sum(held)

    def summed(self, rows: Iterable[tuple], grown: list[tuple], asked: list[list[int]], features: list[int], with_loss: bool) -> Iterator[tuple]:
        """((class, feature), sums of gradients, hessians and rows by asked node and bin), and the loss as (-1, -1)."""
        column = np.zeros(len(self.cuts), np.int64)
        column[features] = np.arange(len(features))
        sums: dict[tuple[int, int], np.ndarray] = {}
        for n, bins, gh, loss, held in rows:
            bins, gh = np.frombuffer(bins, self.kind).reshape(len(features), n), np.frombuffer(gh).reshape(2, self.k, n)
            if with_loss and held:
                sums[-1, -1] = sums.get((-1, -1), 0.0) + np.array([loss, held], float)
            for c in range(self.k):
                if not asked[c] or not n:
                    continue
                feature, *rest = grown[c]
                place = np.full(len(feature), -1)
                place[asked[c]] = np.arange(len(asked[c]))
                at, g, h, own = place[_places(bins, (np.where(feature >= 0, column[feature], -1), *rest), n)], gh[0, c], gh[1, c], bins
                pick = np.flatnonzero(at >= 0)
                if len(pick) < n:
                    at, g, h, own = at[pick], g[pick], h[pick], bins[:, pick]
                for i, f in enumerate(features):
                    width = self.width(f)
                    cell, size = at * width + own[i], len(asked[c]) * width
                    found = np.stack([np.bincount(cell, g, size), np.bincount(cell, h, size), np.bincount(cell, minlength=size)])
                    sums[c, f] = sums.get((c, f), 0.0) + found
        yield from sums.items()

    def width(self, feature: int) -> int:
        return len(self.cuts[feature]) + 2

    def best(self, item: tuple, asked: list[list[int]]) -> list[dict]:
        """Best split of each asked node by one feature; for the loss its sum and rows."""
        (c, f), total = item
        if c < 0:
            return [{"kind": c, "gain": float(total[0]), "sums": [float(total[1])]}]
        sums = np.ascontiguousarray(total.reshape(3, len(asked[c]), self.width(f)).transpose(1, 2, 0))
        gains = best_splits(sums, self.o)
        if self.o.symmetric:
            joint = np.where(np.isfinite(gains), gains, 0.0).sum(0)
            joint[~np.isfinite(gains).any(0)] = -np.inf
            gains = np.broadcast_to(joint, gains.shape)
        done = []
        for i in range(len(asked[c])):
            side, b = divmod(int(np.argmax(gains[i])), gains.shape[2])
            left = sums[i, 1:b + 2].sum(0) + side * sums[i, _MISSING]
            right = sums[i].sum(0) - left
            done.append({"kind": c, "feature": f, "node": i, "gain": float(gains[i, side, b]), "bin": b + 1, "side": bool(side), "sums": [*left.tolist(), *right.tolist()]})
        return done


class _Near:
    """Blocks of a table so small that one task grows all its trees: a job for each pass would cost more than the pass."""

    def __init__(self, pass_: _Pass, blocks: Iterable[tuple]):
        self.k, self.pass_, self.blocks, self.work, self.turn = pass_.k, pass_, list(blocks), [], -1

    def add(self, trees: list[tuple]) -> None:
        self.blocks = [self.pass_.moved(b, trees) for b in self.blocks]

    def close(self) -> None:
        self.blocks, self.work = [], []

    def splits(self, grown: list[tuple], asked: list[list[int]], features: list[int], turn: int, with_loss: bool) -> list[dict]:
        if turn != self.turn:
            self.work, self.turn = list(self.pass_.used(self.blocks, features, turn)), turn
        return [r for item in self.pass_.summed(self.work, grown, asked, features, with_loss) for r in self.pass_.best(item, asked)]


class _Blocks:
    """Blocks in the shared folder with the margins of all rounds up to the last write, and the rows of the round at hand."""

    def __init__(self, pass_: _Pass, source: DataFrame, full: int):
        self.spark, self.k, self.pass_ = source.sparkSession, pass_.k, pass_
        self.margins = self.work = self.path = None
        self.held: list[RDD] = []                             # margins kept in memory, oldest first
        self.turn, self.rounds = -1, 0                        # the round of ``work``; rounds since the last write
        cores = self.spark.sparkContext.defaultParallelism
        self.every = max(1, min(WRITE_ROUNDS, WRITE_ROUNDS * cores // full))
        self.slots = max(1, min(len(pass_.cuts) * self.k, full, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        # As many parts for each core.
        size = full * BLOCK_ROWS * (len(pass_.cuts) * np.dtype(pass_.kind).itemsize + 9 + 8 * self.k)
        self.parts = min(full, cores * max(1, -(-size // (PART_BYTES * cores))))
        self._keep(source.repartition(self.parts).rdd.map(tuple))

    def _keep(self, blocks: RDD) -> None:
        path = scratch_path(self.spark, "blocks")
        blocks.saveAsPickleFile(path, 1)
        self.close()
        if self.path is not None:
            drop_folder(self.spark, self.path)              # the new blocks hold everything
        # A file read back in pieces leaves empty ones, which would add up from write to write.
        self.margins, self.path, self.rounds = self.spark.sparkContext.pickleFile(path).coalesce(self.parts), path, 0

    def write(self) -> None:
        self._keep(self.margins)

    def close(self) -> None:
        for kept in (*self.held, self.work):
            if kept is not None:
                kept.unpersist()
        self.held, self.work, self.turn = [], None, -1

    def add(self, trees: list[tuple]) -> None:
        pass_ = self.pass_
        self.margins, self.rounds = self.margins.map(lambda b: pass_.moved(b, trees)), self.rounds + 1
        if self.rounds == self.every:
            self.write()
            return
        self.held.append(self.margins.persist(StorageLevel.MEMORY_AND_DISK))
        for kept in self.held[:-2]:                          # the round that ends has worked out the one before the last
            kept.unpersist()
        del self.held[:-2]

    def splits(self, grown: list[tuple], asked: list[list[int]], features: list[int], turn: int, with_loss: bool) -> list[dict]:
        pass_ = self.pass_
        if turn != self.turn:
            if self.work is not None:
                self.work.unpersist()
            self.work = self.margins.mapPartitions(lambda blocks: pass_.used(blocks, features, turn)).persist(StorageLevel.MEMORY_AND_DISK)
            self.turn = turn
        parts = self.work.mapPartitions(lambda rows: pass_.summed(rows, grown, asked, features, with_loss))
        if self.work.getNumPartitions() * sum(map(len, asked)) * sum(map(pass_.width, features)) * 24 > SUM_BYTES:
            return parts.reduceByKey(np.add, self.slots).flatMap(lambda item: pass_.best(item, asked)).collect()
        totals: dict[tuple[int, int], np.ndarray] = {}
        for key, sums in parts.collect():
            totals[key] = totals[key] + sums if key in totals else sums
        return [r for item in totals.items() for r in pass_.best(item, asked)]


def _blocks_of(rows: DataFrame, full: int, validation: str | None, pass_: _Pass, base: np.ndarray) -> DataFrame:
    cuts, kind = pass_.cuts, pass_.kind

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                n = part.num_rows
                column = part.column(1)
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                bins = np.empty((x.shape[1], n), kind)
                for f, c in enumerate(cuts):
                    bins[f] = np.where(np.isnan(x[:, f]), _MISSING, 1 + np.searchsorted(c, x[:, f], side="left"))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([int(part.column(0)[0].as_py())], pa.int64()), "n": pa.array([n], pa.int32()), "bins": [bins.tobytes()],
                    "label": [part.column(2).to_numpy().astype(float).tobytes()], "held": [part.column(3).to_numpy(zero_copy_only=False).astype(bool).tobytes()],
                    "margin": [np.tile(base[:, None], (1, n)).tobytes()]})

    flag = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    source = rows.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), flag.alias("held"))
    # Small tables lie in few blocks: a pass costs little more than its tasks do.
    return source.coalesce(full).mapInArrow(made, "block bigint, n int, bins binary, label binary, held binary, margin binary")


class HistogramBooster:
    """Estimator: rows with ``features``, ``label`` (and a boolean validation column) to a ``BoostedModel``.

    With ``validation`` the rounds end once the loss on those rows has not fallen for ``patience``
    rounds, and the model is cut to its best round. Rows of a NULL label are left out. Without
    rows to learn from the model is its base value.
    """

    def __init__(self, task: str, options: BoostOptions, n_classes: int = 2, validation: str | None = None):
        self.task, self.options, self.n_classes, self.validation = task, options, n_classes, validation

    def fit(self, df: DataFrame) -> BoostedModel:
        o, classes = self.options, 1 if self.task == "regression" else max(2, self.n_classes)
        rows = df.where(F.col("label").isNotNull())
        train = rows.where(~F.coalesce(F.col(self.validation), F.lit(False))) if self.validation else rows
        first = rows.select(F.size(vector_to_array("features")).alias("n")).first()
        width = first["n"] if first else 0
        cuts = _cut_points(train, width, o.bins)
        base = _base(train, classes)
        pass_, n, held_out = _Pass(cuts, classes, base, o), rows.count(), self.validation is not None
        full = max(1, -(-n // BLOCK_ROWS))
        source = _blocks_of(rows, full, self.validation, pass_, base)
        if full <= NEAR_BLOCKS and n * width * len(base) <= NEAR_CELLS:
            near = source.rdd.map(tuple).coalesce(1).mapPartitions(lambda blocks: [_grown(_Near(pass_, blocks), pass_, width, held_out)])
            trees, gains, curve, rounds = (near.collect() or [_grown(_Near(pass_, []), pass_, width, held_out)])[0]
        else:
            trees, gains, curve, rounds = _grown(_Blocks(pass_, source, full), pass_, width, held_out)
        model = BoostedModel(self.task, width, classes, base, trees, gains, curve, rounds, o)
        return model.cut_to(int(np.argmin(curve)) + 1) if curve else model


def _grown(blocks: _Near | _Blocks, pass_: _Pass, width: int, held_out: bool) -> tuple[Trees, np.ndarray, tuple[float, ...], int]:
    """All rounds: trees, gains of the features, validation losses and the number of rounds."""
    o = pass_.o
    rounds: list[list[list[dict]]] = []
    curve: list[float] = []
    rng = np.random.Generator(np.random.PCG64([o.seed, 1]))
    best, stop = 0, False
    while not stop:
        finished = len(rounds) == o.trees
        if finished and not held_out:
            break
        features = sorted(rng.permutation(width)[:max(1, round(o.column_share * width))].tolist()) if width else []
        grown = _Growing(blocks.k)
        loss = _grow(blocks, grown, features, len(rounds), finished, held_out, o)
        if loss is not None and rounds:
            curve.append(loss[0] / loss[1])
            best = int(np.argmin(curve)) + 1
            stop = len(curve) - best >= o.patience
        if finished or stop:
            break
        if all(len(n) == 1 for n in grown.nodes) and o.row_share >= 1 and o.column_share >= 1:
            stop = True                                                # nothing is left to split
        for nodes in grown.nodes:
            for e in nodes:
                e["value"] *= o.rate
        rounds.append(grown.nodes)
        blocks.add([grown.arrays(c) for c in range(blocks.k)])
    blocks.close()
    trees, gains = _assembled(rounds, pass_.cuts, width)
    return trees, gains, tuple(curve), len(rounds)


def _grow(blocks: _Near | _Blocks, grown: _Growing, features: list[int], turn: int, only_loss: bool, held_out: bool, o: BoostOptions) -> tuple[float, float] | None:
    """Grow one round's trees level by level; returns the validation loss of the rounds before."""
    loss = None
    known: list[dict[int, dict]] = [{} for _ in grown.nodes]         # best split of nodes not yet split
    asked = [[0] for _ in grown.nodes]
    first = True
    while any(asked) and features:
        if only_loss:
            asked = [[] for _ in grown.nodes]
        found: dict[tuple[int, int], list[dict]] = {}
        for r in blocks.splits([grown.arrays(c) for c in range(len(grown.nodes))], asked, features, turn, first and held_out):
            if r["kind"] < 0:
                loss = (r["gain"], r["sums"][0])
            else:
                found.setdefault((r["kind"], asked[r["kind"]][r["node"]]), []).append(r)
        first = False
        if only_loss:
            return loss
        for (c, node), splits in found.items():
            top = max(splits, key=lambda r: (r["gain"], -r["feature"]))
            if top["gain"] > 0:
                known[c][node] = top
            elif node == 0:
                grown.nodes[c][0]["value"] = _value(np.add(top["sums"][:3], top["sums"][3:]), o)
        asked = [_split(grown.nodes[c], known[c], o) for c in range(len(grown.nodes))]
        while not any(asked) and any(known):
            asked = [_split(grown.nodes[c], known[c], o) for c in range(len(grown.nodes))]
    return loss


def _split(nodes: list[dict], known: dict[int, dict], o: BoostOptions) -> list[int]:
    """Split the nodes of highest gain that the limits allow; returns the new nodes to ask for.

    With a limit on leaves a pass splits, best first, the leaves of at least half the best gain: the
    tree grows where most is gained, and takes few passes. The others wait for the new ones.
    """
    new = []
    leaves = sum(e["feature"] < 0 for e in nodes)
    top = max((e["gain"] for e in known.values()), default=0.0)
    for node in sorted(known, key=lambda n: (-known[n]["gain"], n)):
        if o.leaves and leaves >= o.leaves:
            known.clear()
            break
        if o.leaves and known[node]["gain"] < top / 2:
            break
        if o.depth and nodes[node]["depth"] >= o.depth:
            del known[node]
            continue
        split = known.pop(node)
        e, left, right = nodes[node], np.array(split["sums"][:3]), np.array(split["sums"][3:])
        e.update(feature=split["feature"], bin=split["bin"], missing_left=split["side"], left=len(nodes), right=len(nodes) + 1, gain=split["gain"])
        for sums in (left, right):
            nodes.append({**_leaf(_value(sums, o), e["depth"] + 1), "weight": float(sums[2])})
            new.append(len(nodes) - 1)
        leaves += 1
    if o.leaves and leaves >= o.leaves:
        known.clear()
        return []
    return [n for n in new if not o.depth or nodes[n]["depth"] < o.depth]


def _value(sums: np.ndarray, o: BoostOptions) -> float:
    down = sums[1] + o.l2
    return float(-_shrunk(np.array(sums[0]), o.l1) / down) if down > 0 else 0.0


def _cut_points(train: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts between bins for each feature: distinct values of a mergeable quantile sketch.

    A value up to and including a cut falls into the bin before it; the last bin is open.
    """
    if not width:
        return []
    shares = [i / bins for i in range(1, bins)]
    x = train.select(vector_to_array("features").alias("x"))
    value = [F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))) for i in range(width)]
    row = x.agg(*[F.percentile_approx(v, shares, 100 * bins).alias(f"q{i}") for i, v in enumerate(value)],
                *[F.max(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    cuts = []
    for i in range(width):
        found = np.unique(np.array(row[f"q{i}"] or [], float))
        cuts.append(found[found < row[f"m{i}"]] if row[f"m{i}"] is not None else found)
    return cuts


def _base(train: DataFrame, classes: int) -> np.ndarray:
    if classes == 1:
        return np.array([train.agg(F.avg("label")).first()[0] or 0.0])
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    total = max(1, sum(counts.values()))
    shares = np.array([min(1 - 1e-6, max(1e-6, counts.get(c, 0) / total)) for c in range(classes)])
    return np.array([np.log(shares[1] / shares[0])]) if classes == 2 else np.log(shares)


def _assembled(rounds: list[list[list[dict]]], cuts: list[np.ndarray], width: int) -> tuple[Trees, np.ndarray]:
    nodes, root, kind, gains = [], [], [], np.zeros(width)
    for grown in rounds:
        for c, tree in enumerate(grown):
            at = len(nodes)
            root.append(at)
            kind.append(c)
            for e in tree:
                inner = e["feature"] >= 0
                if inner:
                    gains[e["feature"]] += max(0.0, e["gain"])
                cut = cuts[e["feature"]][e["bin"] - 1] if inner and e["bin"] <= len(cuts[e["feature"]]) else np.inf
                nodes.append((e["feature"], float(cut), e["missing_left"], e["left"] + at if inner else -1, e["right"] + at if inner else -1, e["value"], e["weight"]))
    columns = list(zip(*nodes)) if nodes else [[]] * 7
    kinds = (np.int64, float, bool, np.int64, np.int64, float, float)
    return Trees(*[np.array(v, t) for v, t in zip(columns, kinds)], np.array(root, np.int64), np.array(kind, np.int64)), gains
