"""Helpers shared by the corpus operators: global order by ranges, Arrow rows, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import cut_lineage, scratch_path

#: Sampled keys for each range; more make the ranges more even and never change a result.
SAMPLE_PER_RANGE = 16


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: a lost executor cannot take the rows away."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_in_arrow(function: Callable[..., Iterable[tuple]], schema: pa.Schema, columns: list[str], batch_rows: int = 4096):
    """A ``mapInArrow`` function from one over plain row tuples (columns in the given order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))

        out: list[tuple] = []
        for row in function(rows()):
            out.append(row)
            if len(out) >= batch_rows:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Ranges:
    """Ranges of an ordering key, cut at a bounded random sample of its values.

    The cuts then are literals, so a recomputed task deals every row to the same range again.
    ``first`` holds each range's smallest key; both lists have at most ``n`` entries.
    """

    def __init__(self, df: DataFrame, key: Column, n: int):
        keys = df.select(key.alias("k"))
        sample = sorted(r.k for r in keys.where("k IS NOT NULL").orderBy(F.rand(7)).limit(n * SAMPLE_PER_RANGE).collect())
        step = max(1, len(sample) // n)
        self.cuts = sorted(set(sample[step::step][: n - 1]))
        ends = keys.where("k IS NOT NULL").withColumn("b", self.number(F.col("k"))).groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
        self.ends = {r.b: (r.lo, r.hi) for r in ends}
        self.order = sorted(self.ends)

    def number(self, key: Column) -> Column:
        """The number of the key's range."""
        if not self.cuts:
            return F.lit(0)
        cuts = F.lit(self.cuts)
        return F.size(F.filter(cuts, lambda c: c <= key))

    def _among(self, key: Column, values: list) -> Column:
        return key.isin(*values) if values else F.lit(False)

    def with_guests(self, df: DataFrame, key: Column, before: bool, after: bool, ring: bool = False) -> DataFrame:
        """Rows with ``range`` and ``guest`` (0: own; 1: first of the next range; -1: last of the one before)."""
        own = self.number(key)
        copies = [F.struct(own.alias("range"), F.lit(0).alias("guest"))]
        none = F.lit(None).cast("struct<range:int,guest:int>")
        order = self.order

        def guest(place: dict[int, int], kind: int) -> Column:
            if not place:
                return none
            here = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
            ends = [self.ends[b][0 if kind > 0 else 1] for b in place]
            return F.when(self._among(key, ends), F.struct(here[own].alias("range"), F.lit(kind).alias("guest"))).otherwise(none)

        if after:
            to = {b: order[i - 1] for i, b in enumerate(order) if i or ring}
            copies.append(guest(to, 1))
        if before:
            copies.append(guest({b: order[i + 1] for i, b in enumerate(order[:-1])}, -1))
        return df.withColumn("copy", F.explode(F.array_compact(F.array(*copies)))).select("*", "copy.range", "copy.guest").drop("copy")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)`` of an edge table ``(a, b)`` of BIGINT; component is the smallest node.

    Alternating large-star and small-star steps; each round is checkpointed in the shared
    folder. Stops when a round changes no edge; a round never emits more edges than it reads,
    and the smallest neighbour of a hot node is found by a partial aggregate.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut_lineage(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
