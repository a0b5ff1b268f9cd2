"""Operator 10: packing documents into sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``max_tokens`` numbers) comes to the driver. All
patterns of one to three lengths that fill a sequence exactly are enumerated; least squares
with non-negative repeat counts (multiplicative updates) fit them to the histogram; counts are
rounded in several ways (the best plan stays), and the residual lengths are packed
best-fit, whole runs of equal sequences at a time. Tasks then number the pieces of each length and look up their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.bpe import encoder
from tablewright.llm.common import partitions, plain_text, slices, stored

MAX_TOKENS = 1024
END_ID = 2
FIT_ROUNDS = 300
#: Shares of the fitted counts that are rounded down; the rest is residual.
ROUNDED_SHARES = (1.0, 0.8, 0.5)

#: A pattern is (lengths, descending; how often it is repeated).
Plan = list[tuple[tuple[int, ...], int]]


def patterns(size: int) -> np.ndarray:
    """All ways to fill ``size`` with two or three lengths, zero meaning none (columns descend)."""
    out = []
    for a in range(-(-size // 3), size):
        rest = size - a
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, rest - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_plan(histogram: dict[int, int], size: int, rounds: int = FIT_ROUNDS) -> Plan:
    """Repeat counts of patterns that use up a histogram of lengths ``1..size`` exactly."""
    left = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        if not 1 <= length <= size:
            raise ValueError(f"length {length} does not fit a sequence of {size}")
        left[length] += count
    plan: Plan = []
    if left[size]:
        plan.append(((size,), int(left[size])))
        left[size] = 0
    table = patterns(size)
    table = table[((left[table] > 0) | (table == 0)).all(1)]
    if len(table):
        some = (table > 0).astype(float)
        want = left.astype(float)
        want[0] = 0
        x = np.full(len(table), want.sum() / max(1.0, some.sum()))
        goal = (want[table] * some).sum(1)
        for _ in range(rounds):
            made = np.bincount(table.ravel(), (x[:, None] * some).ravel(), size + 1)
            x *= goal / np.maximum((made[table] * some).sum(1), 1e-12)
        order = np.argsort(-x, kind="stable")
        tried = [_rounded(table, np.floor(x * share + 1e-9), order, left, size) for share in ROUNDED_SHARES]
        tried.append(_rounded(table, np.where(x < 1e-3, 0, np.maximum(1, np.round(x))), order, left, size))
        return plan + min(tried, key=lambda p: sum(times for _, times in p))
    return plan + best_fit(left, size)


def _rounded(table: np.ndarray, repeats: np.ndarray, order: np.ndarray, left: np.ndarray, size: int) -> Plan:
    """Whole repeat counts within what is left, most repeated patterns first, and the residual."""
    plan, left = [], left.copy()
    for k in order:
        if repeats[k] < 1:
            break
        lengths = table[k][table[k] > 0]
        need = np.bincount(lengths, minlength=size + 1)
        times = min(int((left[lengths] // need[lengths]).min()), int(repeats[k]))
        if times:
            plan.append((tuple(lengths.tolist()), times))
            left -= need * times
    return plan + best_fit(left, size)


def best_fit(left: np.ndarray, size: int) -> Plan:
    """Best-fit of the lengths that are left (consumed): each sequence takes the largest that fits."""
    plan: Plan = []
    while left.any():
        there = np.flatnonzero(left)
        room, taken = size, {}
        while True:
            at = int(np.searchsorted(there, room, side="right")) - 1
            while at >= 0 and left[there[at]] <= taken.get(int(there[at]), 0):
                at -= 1
            if at < 0:
                break
            length = int(there[at])
            fits = min(room // length, int(left[length]) - taken.get(length, 0))
            taken[length] = taken.get(length, 0) + fits
            room -= fits * length
        times = min(int(left[v]) // c for v, c in taken.items())
        for v, c in taken.items():
            left[v] -= c * times
        plan.append((tuple(v for v in sorted(taken, reverse=True) for _ in range(taken[v])), times))
    return plan


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """For every (length, pattern): first rank, copies in a sequence, first sequence, first offset."""
    rows, base = [], 0
    used: dict[int, int] = {}
    for lengths, times in plan:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            start = used.get(length, 0)
            rows.append((length, start, copies, base, at))
            used[length] = start + copies * times
            at += copies * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "copies", "base", "at"), table.T))


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; of a longer document the first piece is the short one."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in slices(texts):
                out: list[tuple] = []
                for doc, packed in zip(ids[first:last], coder.encode(texts[first:last])):
                    packed = memoryview(packed + end)
                    total = len(packed) // 4
                    start, stop = 0, total % max_tokens or max_tokens
                    for number in range(-(-total // max_tokens)):
                        out.append((doc, number, start, stop - start, zlib.crc32(packed[4 * start:4 * stop])))
                        start, stop = stop, stop + max_tokens
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(names))

    return source.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece.

    A NULL text is a lone end id; NULL and repeated doc_ids are packed like any other row; an
    empty table gives no rows; other columns are not read. Sequences are filled without gaps
    from 0 and hold at most ``max_tokens`` ids.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, max_tokens, end_id), "pieces")
    plan = fit_plan({r.length: r["count"] for r in cut.groupBy("length").count().collect()}, max_tokens)
    places = _places(plan)
    slots = 4 * partitions(spark)
    dealt = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    sizes = dealt.groupBy("length", "slot").count()
    before = sizes.select("length", "slot", (F.sum("count").over(Window.partitionBy("length").orderBy("slot")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "slot"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("bigint").alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(places["start"].max()) + 1 if len(places["start"]) else 1
        ends = places["length"] * width + places["start"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(ends, length * width + np.minimum(rank, width - 1), side="right") - 1
            inside, copies = rank - places["start"][at], places["copies"][at]
            sequence = places["base"][at] + inside // copies
            offset = places["at"][at] + inside % copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
