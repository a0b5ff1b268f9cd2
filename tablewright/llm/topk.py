"""Operator 5: exact top-k inner products by the threshold algorithm.

Candidates are dealt to blocks; a block sorts its vectors along every dimension. A query reads
all lists in step (from the top for a positive weight, from the bottom for a negative one),
scores what it meets by random access, and stops when the score that the values at the current
depth could reach at most is below its kth best. Queries are dealt to blocks too, and each
pair of blocks is a task of its own, so neither side is held whole anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one candidate block and queries of one query block.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
FIRST_DEPTH = 8


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, x ARRAY<BIGINT>)``: floor(scale * component); unusable vectors are left out.

    Left out: NULL or empty vectors and vectors with a NULL, NaN or infinite component, and
    rows of NULL id, which no result could name.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ready = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~F.coalesce(bad, F.lit(True)))
    return ready.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("bigint")).alias("x"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in ascending id, so that a stable sort settles ties."""
    ids = table.column("vec_id").to_numpy()
    values = table.column("x").combine_chunks()
    flat = values.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat[order]


class SortedLists:
    """One block of vectors, sorted along each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()                 # (dimensions, rows), ascending
        self.values = np.take_along_axis(x, self.order.T, 0).T.copy()

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best, ties to smaller ids; rows of id ``own`` do not count."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        up, down = used[q[used] > 0], used[q[used] < 0]
        seen = self.ids == own
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = 0, min(n, FIRST_DEPTH)
        while low < n:
            met = np.zeros(n, bool)
            met[self.order[up, n - high:n - low].ravel()] = True
            met[self.order[down, low:high].ravel()] = True
            if not len(used):                                                      # every score is zero
                met[:] = True
                high = n
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            best = np.concatenate((best, new))
            score = np.concatenate((score, self.x[new] @ q))
            keep = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[keep], score[keep]
            if high < n and len(best) == k:
                bound = int(q[up] @ self.values[up, n - high - 1] + q[down] @ self.values[down, high])
                if bound < score[-1]:
                    break
            low, high = high, min(n, 2 * high)
        return best, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products.

    Both tables hold ``(vec_id, x ARRAY<BIGINT>)`` as from ``integer_vectors``; vectors of
    another length than the query are no candidates of it. A query's own id is never a
    candidate; ties go to the smaller vec_id; with fewer candidates all are returned. Of
    repeated query rows of one id the least vector asks; repeated candidate rows are
    candidates each. Empty tables give no rows. Scores must fit in 63 bits.
    """
    count = vectors.groupBy(F.size("x").alias("dims")).count().collect()           # a row for each vector length
    blocks = {r.dims: -(-r["count"] // CANDIDATE_BLOCK) for r in count}
    if not blocks:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    asked = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    query_blocks = {r.dims: -(-r["count"] // QUERY_BLOCK) for r in asked.groupBy(F.size("x").alias("dims")).count().collect()}
    number = F.create_map(*(F.lit(v) for d, b in blocks.items() for v in (d, b)))
    query_number = F.create_map(*(F.lit(v) for d in blocks for v in (d, query_blocks.get(d, 0))))
    dims = F.size("x")
    cell = ["dims", "c", "q"]
    left = (vectors.withColumn("dims", dims).where(query_number[F.col("dims")] > 0)
            .withColumn("c", F.pmod(F.xxhash64("vec_id"), number[F.col("dims")].cast("bigint")))
            .withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), query_number[F.col("dims")].cast("bigint") - 1))))
    right = (asked.withColumn("dims", dims).where(number[F.col("dims")].isNotNull())
             .withColumn("q", F.pmod(F.xxhash64("vec_id"), query_number[F.col("dims")].cast("bigint")))
             .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), number[F.col("dims")].cast("bigint") - 1))))

    def search(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and asking.num_rows:
            lists = SortedLists(*_matrix(candidates))
            for own, q in zip(*_matrix(asking)):
                best, score = lists.search(int(own), q, k)
                out["query_id"].extend([int(own)] * len(best))
                out["vec_id"].extend(lists.ids[best].tolist())
                out["score"].extend(score.tolist())
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
