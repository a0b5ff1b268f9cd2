"""Operator 13: how filters interact, over every order in which they could be applied.

A document is reduced to the set of filters it fails (a bit mask); rows are counted for each
part and mask, so that the orders are worked out on small matrices: a mask matrix (masks by
filters, infinite where a filter is passed) and a matrix of inverse permutations (orders by
filters: the step at which each filter runs). Their min-plus product is the step at which an
order removes a mask; counts are scattered to (part, order, step) by that step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import plain_text

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_NEVER = np.int64(1 << 40)

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def failed_by_text(text: bytes, n_chars: int) -> int:
    """Bit mask of the filters A to D that a text fails (A is bit 0)."""
    words = text.split()
    failed = int(len(words) < MIN_WORDS)
    failed |= 2 * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
    failed |= 4 * (100 * (len(text) - len(text.translate(None, _UPPER))) > MAX_UPPER_PERCENT * n_chars)
    failed |= 8 * (len(text) != len(text.translate(None, SYMBOLS)))
    return failed


def _texts_tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column(2).to_pylist():
            raw = text.encode("utf-8", "surrogatepass")
            masks.append(failed_by_text(raw, len(text)))
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                         ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask)`` for every row: the filters that it fails, as bits in the order ABCDE.

    E is failed by a text that a smaller doc_id has too. Only the first doc_id of each text is
    joined back, under text and doc_id, so that a text of very many copies is no hot key. A row
    of NULL doc_id never fails E; repeated rows are counted each.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text(part).alias("part"), plain_text("text").alias("text"))
    rows = source.mapInArrow(_texts_tested, "doc_id bigint, part string, mask int, digest binary")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 16).otherwise(0)).alias("mask"))


def removal_steps(n_filters: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(orders, position, step)``: the orders, each filter's step in them, and each mask's removal step.

    Steps count from 0; ``step`` is (orders, masks), ``n_filters`` for a mask that is never removed.
    """
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1)
    masks = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    weight = np.where(masks == 1, 0, _NEVER)
    step = np.full((len(orders), len(masks)), n_filters, np.int64)
    for f in range(n_filters):
        step = np.minimum(step, position[:, f, None] + weight[None, :, f])
    return orders, position, step


def audited(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Counts (parts, orders, steps) from ``weights`` (parts, masks, 3: documents, good, toxic)."""
    orders, position, step = removal_steps()
    n_parts, n_orders, n_steps = len(weights), len(orders), orders.shape[1]
    at = np.arange(n_orders)[:, None] * (n_steps + 1) + step                       # place of each (order, mask)
    lost = np.zeros((n_parts, n_orders * (n_steps + 1), 3), np.int64)
    for part in range(n_parts):
        np.add.at(lost[part], at, weights[part][None])
    lost = lost.reshape(n_parts, n_orders, n_steps + 1, 3)[:, :, :n_steps]
    masks = np.arange(weights.shape[1])
    fails = (masks[None] >> np.arange(n_steps)[:, None]) & 1                       # (filters, masks)
    failing = weights[:, :, 0] @ fails.T                                           # (parts, filters)
    removed = lost[..., 0]
    by_filter = np.take_along_axis(removed, np.broadcast_to(position, (n_parts, n_orders, n_steps)), 2)
    return {
        "kept": weights[:, :, 0].sum(1)[:, None, None] - removed.cumsum(2), "removed": removed,
        "redundant": failing[:, orders] - removed, "unique_fails": weights[:, 1 << np.arange(n_steps), 0][:, orders],
        "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": by_filter.sum(1)[:, orders]}


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["".join(FILTERS[i] for i in order) for order in permutations(range(len(FILTERS)))]
    steps = np.arange(1, len(FILTERS) + 1, dtype=np.int32)
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            parts = batch.column(0).slice(i, 64).to_pylist()
            weights = np.array(batch.column(1).slice(i, 64).to_pylist(), np.int64).reshape(len(parts), 1 << len(FILTERS), 3)
            counts = audited(weights)
            each = len(names) * len(steps)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.repeat(np.array(parts, object), each), pa.string()),
                "filter_order": pa.array(np.tile(np.repeat(np.array(names, object), len(steps)), len(parts)), pa.string()),
                "step": np.tile(steps, len(parts) * len(names)), **{c: np.ascontiguousarray(counts[c]).ravel() for c in COUNTS}})


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    Columns as in ``SCHEMA``: documents kept after the step and removed by it, those that fail its
    filter but were removed earlier, those that fail no other filter, good and toxic documents
    removed, and the filter's removals summed over all orders. A NULL text or part counts as
    empty; NULL labels are neither good nor toxic; several labels of one doc_id count as one, good
    or toxic if any is; an empty table gives no rows; no other column is read.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs, part).join(marks, "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
                                             F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.array("n", "good", "toxic"))))
    none = F.array(*[F.lit(0).cast("bigint")] * 3)
    weights = F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda m: F.coalesce(F.col("held")[m], none))
    table = cells.groupBy("part").agg(held.alias("held")).select("part", weights.alias("weights"))
    return table.mapInArrow(_audit, SCHEMA)
