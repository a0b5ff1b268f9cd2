"""Operator 9: SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``REFERENCES`` fixed fingerprints,
kept for each of six bit blocks. Two fingerprints at most four bits apart agree on two whole
blocks at least, so they have equal distances there: each of the 15 block pairs is one join
key made of those distances. Within a key, pairs whose full distances differ by more than the
limit at any reference are discarded, and the rest is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, partitions, plain_text, stored

SHINGLE_WORDS = 4
HASH_SEED = 42
MOST_BITS = 4
REFERENCES = 32
BLOCKS = 6
#: A key with more fingerprints is compared in pairs of sub-blocks of about this size.
BUCKET_ROWS = 4096


def shingle_hashes(text: str, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles in order, repeats included; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())], "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _masks() -> np.ndarray:
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])], np.uint64)


def _references() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 63, REFERENCES, np.uint64) * np.uint64(2) + np.arange(REFERENCES, dtype=np.uint64) % np.uint64(2)


def distance_table(values: np.ndarray) -> np.ndarray:
    """Block-wise Hamming distances to the references: (rows, references, blocks)."""
    return np.bitwise_count((values[:, None, None] ^ _references()[None, :, None]) & _masks()[None, None, :])


def block_keys(values: np.ndarray) -> np.ndarray:
    """One key for each pair of blocks, equal where all reference distances in both are equal."""
    table = distance_table(values).astype(np.uint64)
    mix = np.random.Generator(np.random.PCG64(10)).integers(1, 1 << 62, (REFERENCES, BLOCKS), np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        block = (table * mix[None]).sum(1, dtype=np.uint64)
        keys = [(block[:, a] + block[:, b] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(i + 1) for i, (a, b) in enumerate(combinations(range(BLOCKS), 2))]
    return np.stack(keys, 1).view(np.int64)


def linked(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up all near values of equal keys (keys sorted): a forest, not all pairs."""
    coordinates = distance_table(values).sum(2, dtype=np.int16)
    label = np.arange(len(keys))
    parent = label.copy()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    rows = np.arange(len(keys) - 1) if len(keys) else np.arange(0)
    lag = 1
    while len(rows):
        rows = rows[rows + lag < len(keys)]
        rows = rows[keys[rows] == keys[rows + lag]]
        i, j = rows, rows + lag
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        near = (np.abs(coordinates[i] - coordinates[j]).max(1) <= most) if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        near = np.bitwise_count(values[i] ^ values[j]) <= most
        changed = False
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
                changed = True
        if changed:
            flat = parent
            while True:
                up = flat[flat]
                if np.array_equal(up, flat):
                    break
                flat = up
            parent = flat.copy()
            label = flat
        lag += 1
    return values[left].view(np.int64), values[right].view(np.int64)


def _near_links(values: DataFrame, most: int) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that have the right components."""
    n = partitions(values.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                v = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = block_keys(v)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "value": np.repeat(v.view(np.int64), keys.shape[1])})

    rows = values.mapInArrow(keyed, "key bigint, value bigint")
    hot = rows.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("value"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    dealt = rows.join(hot, "key", "left").select("key", "value", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell.lo", "cell.hi").alias("cell"), "value")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, values):
            a, b = linked(keys, values.view(np.uint64), most)
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            held = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False)))
            if len(keys):
                done = np.searchsorted(keys, keys[-1])      # the last key may go on
                if done:
                    yield found(keys[:done], held[:done])
                    keys, held = keys[done:], held[done:]
        if len(keys):
            yield found(keys, held)

    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "value").mapInArrow(links, "a bigint, b bigint").distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, value BIGINT)``: the fingerprint of each whole text (NULL: no words)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "value": pa.array(values, pa.int64())})

    return source.mapInArrow(run, "doc_id bigint, value bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Fingerprints at most ``most`` (4 or fewer) bits apart are linked; component_id is the
    smallest doc_id that links reach, its own included. Texts without words have fingerprint
    zero and are linked like any other. Rows of NULL doc_id take part but never name a
    component; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} differing bits can be searched")
    marked = stored(fingerprints(docs, shingle), "simhash")
    distinct = marked.groupBy("value").agg(F.min("doc_id").alias("first"))
    links = components(_near_links(distinct.select("value"), most))
    grouped = distinct.join(links, distinct["value"] == links["node"], "left").select("value", "first", F.coalesce("component", "value").alias("component"))
    named = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(named, "component").select("value", "component_id")
    out = marked.join(named, "value")
    return out.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")
