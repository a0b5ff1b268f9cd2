"""Operator 11: b-bit MinHash near-duplicates, confirmed on whole shingle sets.

Each distinct shingle set gets ``MINIMA`` minima under multiplicative permutations. Bands of the
first minima are bucket keys; of every minimum the lowest ``BITS`` bits are kept, packed into
machine words. In a bucket, similarity is estimated by counting equal bit groups and corrected
for chance agreement. Sets that a bucket joins up by estimate form candidate groups. A group's
texts meet once, whatever the number of its buckets, and there the links are taken from the
whole sets: by the lists of sets that hold each shingle, from one set to all that are still
without a link. No pairs leave a task but the links of a forest.

What can be lost: a pair of the least similarity shares no band with a probability below 1e-8,
and is ``SLACK`` standard deviations off its estimate with about 1e-9; more alike pairs less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, partitions, plain_text, slices, stored

MINIMA = 256
BITS = 2
BANDS = 32
SLACK = 6.0
#: Members of one block of a bucket, and text bytes of one block of a group; larger ones are
#: compared in pairs of blocks. They bound memory and never change a result.
BUCKET_ROWS = 4096
BLOCK_BYTES = 4_000_000
#: A shingle set of at least this share of the rows is spread over salts when rows look it up.
_HOT_SHARE, _SALTS = 0.001, 64
#: Nodes of sets whose rows all lack a doc_id.
_NAMELESS = 1 << 62

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(11))
_CODE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Similarity:
    """Sets of ``words``-word shingles are linked from ``share / of_all`` on; ``rows`` minima make a band."""

    words: int = 3
    share: int = 85
    of_all: int = 100
    rows: int = 5

    @property
    def least_equal(self) -> int:
        """Equal bit groups below which two sets cannot be similar enough, but for ``SLACK`` deviations."""
        chance, least = 0.5 ** BITS, self.share / self.of_all
        p = chance + (1 - chance) * least
        deviation = np.sqrt(p * (1 - p) / MINIMA) / (1 - chance)
        return int(np.floor(MINIMA * (chance + (1 - chance) * max(0.0, least - SLACK * deviation))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    length = ends - starts
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(length.max()) - 1, _BASE, np.uint64))))
        step = np.flatnonzero(~blank) - np.repeat(starts, length)
        code = _CODE[data[~blank]] * power[step]
        word = _mixed(np.add.reduceat(code, np.concatenate(([0], np.cumsum(length)[:-1]))) + length.astype(np.uint64))
        m = len(word) - words + 1
        shingle = np.zeros(max(0, m), np.uint64)
        for k in range(words):
            shingle = shingle * _STEP + word[k:k + max(0, m)]
        shingle = _mixed(shingle)
    limits = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
    out, first = [], 0
    for last in limits.tolist():
        if last - first >= words:
            out.append(np.unique(shingle[first:last - words + 1]))
        elif last > first:
            with np.errstate(over="ignore"):
                whole = np.zeros(1, np.uint64)
                for w in word[first:last]:
                    whole = whole * _STEP + w
                out.append(_mixed(whole ^ np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``MINIMA`` minima of each non-empty set."""
    out = np.empty((len(sets), MINIMA), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 32_768):
            size += len(sets[j])
            j += 1
        joined = np.concatenate(sets[i:j])
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j]])[:-1]))
        with np.errstate(over="ignore"):
            for k in range(MINIMA):
                out[i:j, k] = np.minimum.reduceat(joined * _TURN[k], at)
        i = j
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each minimum, packed into 64-bit words."""
    with np.errstate(over="ignore"):
        bits = _mixed(least) >> np.uint64(64 - BITS)
    each = 64 // BITS
    shift = (np.arange(each, dtype=np.uint64) * np.uint64(BITS))[None, None]
    return np.bitwise_or.reduce(bits.reshape(len(least), MINIMA // each, each) << shift, axis=2)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """``BANDS`` bucket keys of ``rows`` minima each."""
    with np.errstate(over="ignore"):
        used = least[:, :BANDS * rows].reshape(len(least), BANDS, rows)
        keys = np.zeros((len(least), BANDS), np.uint64)
        for k in range(rows):
            keys = _mixed(keys * _STEP + used[:, :, k])
        return (keys ^ (np.arange(BANDS, dtype=np.uint64) * _STEP)).view(np.int64)


def equal_groups(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of equal bit groups of one signature with each of the others."""
    differ = one[None] ^ others
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    low = differ & mask
    for b in range(1, BITS):
        low |= (differ >> np.uint64(b)) & mask
    return MINIMA - np.bitwise_count(low).sum(1, dtype=np.int64)


def joined_by_estimate(sizes: np.ndarray, signatures: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins all members whose estimate allows the least similarity."""
    rest, left, right = np.arange(len(sizes)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = like.share * np.maximum(sizes[x], sizes[rest]) <= like.of_all * np.minimum(sizes[x], sizes[rest])
            near &= equal_groups(signatures[x], signatures[rest]) >= like.least_equal
            found = rest[near]
            left += [x] * len(found)
            right += found.tolist()
            queue += found.tolist()
            rest = rest[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def linked_sets(sets: list[np.ndarray], like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Links (true ones, on whole sets) of a forest that joins all sets that links reach."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), size)
    common = times[codes] > 1                                              # others cannot be shared
    popular = np.bincount(owner[common], times[codes[common]], len(sets)) / size
    owner, codes = owner[common], codes[common]
    held = np.bincount(owner, minlength=len(sets))
    at = np.concatenate(([0], np.cumsum(held)))
    rest = np.argsort(-popular, kind="stable")
    rest = rest[like.of_all * held[rest] >= like.share * size[rest]]
    left, right = [], []
    listed, lists, ends = 0, None, None

    def index() -> None:                                                   # sets that hold each shingle
        nonlocal listed, lists, ends
        open_ = np.zeros(len(sets), bool)
        open_[rest] = True
        kept = open_[owner]
        order = np.argsort(codes[kept], kind="stable")
        lists = owner[kept][order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(codes[kept], minlength=len(times)))))
        listed = len(rest)

    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            # No more can be shared than both hold of what others hold too.
            bound = (like.share + like.of_all) * np.minimum(held[x], held[rest]) >= like.share * (size[x] + size[rest])
            if not bound.any():
                continue
            if lists is None or 2 * len(rest) < listed:
                index()
            mine = codes[at[x]:at[x + 1]]
            a, n = ends[mine], ends[mine + 1] - ends[mine]
            places = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            both = np.bincount(lists[places], minlength=len(sets))[rest]
            near = like.of_all * both >= like.share * (size[x] + size[rest] - both)
            found = rest[near]
            left += [x] * len(found)
            right += found.tolist()
            queue += found.tolist()
            rest = rest[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def _marked(docs: DataFrame, like: Similarity, mark: Callable[[np.ndarray], int] | None) -> DataFrame:
    """``(doc_id, body, key, size, value, bits, bands)`` of every row; body is a digest of its text, value the ``mark`` of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], like.words)
                full = [i for i, s in enumerate(sets) if len(s)]
                least = minima([sets[i] for i in full])
                packed, bands = packed_bits(least), band_keys(least, like.rows)
                bits, keys = [None] * len(sets), [None] * len(sets)
                values = np.array([mark(s) if mark else 0 for s in sets], np.uint64).view(np.int64)
                for row, i in enumerate(full):
                    bits[i], keys[i] = packed[row].tobytes(), bands[row].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "body": batch.column(1).slice(a, b - a), "key": pa.array([set_key(s) for s in sets], pa.binary()),
                    "size": pa.array([len(s) for s in sets], pa.int64()), "value": values, "bits": pa.array(bits, pa.binary()), "bands": pa.array(keys, pa.binary())})

    source = _source(docs)
    return source.mapInArrow(run, "doc_id bigint, body binary, key binary, size bigint, value bigint, bits binary, bands binary")


def _source(docs: DataFrame) -> DataFrame:
    text = plain_text("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("body"), text.alias("text"))


def _in_runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Whole runs of equal values of a column, several at once, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        if held and keys[0] != held[-1].column(column)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        done = int(np.searchsorted(keys, keys[-1]))
        if done:
            yield pa.Table.from_batches([*held, batch.slice(0, done)])
            held = []
        held.append(batch.slice(done))
    if held:
        yield pa.Table.from_batches(held)


def _runs_of(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return zip(cuts, cuts[1:])


def _dealt(rows: DataFrame, key: str, parts: Column, own: Column) -> DataFrame:
    """Rows under ``cell``: their key, or one cell for each pair of blocks of a large key."""
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64(F.col(key), F.least(own, j), F.greatest(own, j)))
    return rows.withColumn("cell", F.explode(F.when(parts <= 1, F.array(F.col(key))).otherwise(pairs)))


def candidate_edges(sets: DataFrame, like: Similarity) -> DataFrame:
    """``(a, b)``: edges that join up sets (node, size, bits, bands) by the estimates in their buckets."""
    n = partitions(sets.sparkSession)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_pydict({"key": keys, "node": np.repeat(part.column(0).to_numpy(), BANDS)})

    def of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_node, place = None, None, 0                             # place of the last row in its bucket
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            index = np.where(begin < 0, place + 1 + np.arange(len(keys)), np.arange(len(keys)) - begin)
            keep = index > 0
            ahead = np.flatnonzero(keep & (index == 1))                    # their first rows wait for company
            out_key, out_node, out_block = [keys[keep]], [nodes[keep]], [index[keep] // BUCKET_ROWS]
            firsts = [nodes[i - 1] if i else last_node for i in ahead.tolist()]
            out_key.append(keys[ahead])
            out_node.append(np.array(firsts, np.int64))
            out_block.append(np.zeros(len(ahead), np.int64))
            last, last_node, place = keys[-1], nodes[-1], int(index[-1])
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(out_key), "node": np.concatenate(out_node), "block": np.concatenate(out_block).astype(np.int32)})

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_runs(batches):
            cells, node, size = (table.column(c).to_numpy() for c in ("cell", "node", "size"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            left, right = [], []
            for a, b in _runs_of(cells):
                x, y = joined_by_estimate(size[a:b], bits[a:b], like)
                left.append(node[a:b][x])
                right.append(node[a:b][y])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(left), "b": np.concatenate(right)})

    keys = sets.where("size > 0").select("node", "bands").mapInArrow(banded, "key bigint, node bigint").distinct()
    several = stored(keys.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(of_several, "key bigint, node bigint, block int"), "buckets")
    blocks = several.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("parts"))
    cells = _dealt(several.join(blocks, "key", "left"), "key", F.coalesce("parts", F.lit(1)), F.col("block"))
    met = cells.select("cell", "node").join(sets.select("node", "size", "bits"), "node").select("cell", "node", "size", "bits")
    return met.repartition(n, "cell").sortWithinPartitions("cell", "node").mapInArrow(estimated, "a bigint, b bigint").distinct()


def true_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, like: Similarity) -> DataFrame:
    """``(a, b)``: links between the sets of each group ``(node, component)``, whole texts compared.

    ``sets`` names the row (doc_id, body) that stands for each node.
    """
    n = partitions(docs.sparkSession)
    wanted = stored(sets.join(groups, "node").select(F.col("component").alias("group"), "node", "doc_id", "body", "size"), "grouped")
    blocks = wanted.groupBy("group").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).cast("int").alias("parts")).where("parts > 1")
    named = wanted.join(blocks, "group", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    same = F.col("w.body").eqNullSafe(F.col("d.body")) & F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))
    # Under text and doc_id, so that many copies of a text are no hot key; one plan at every size.
    texts = _source(docs).alias("d").join(named.hint("merge").alias("w"), same).select("w.group", "w.node", "w.parts", F.col("d.text").alias("text"))
    cells = _dealt(texts, "group", F.coalesce("parts", F.lit(1)), own).select("cell", "node", "text")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_runs(batches):
            cells, node, texts = table.column("cell").to_numpy(), table.column("node").to_numpy(), table.column("text").to_pylist()
            left, right = [], []
            for a, b in _runs_of(cells):
                kept = [i for i in range(a, b) if i == a or node[i] != node[i - 1] or texts[i] != texts[i - 1]]     # not repeated rows
                x, y = linked_sets(shingle_sets([texts[i] for i in kept], like.words), like)
                left.append(node[kept][x])
                right.append(node[kept][y])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(left).astype(np.int64), "b": np.concatenate(right).astype(np.int64)})

    return cells.repartition(n, "cell").sortWithinPartitions("cell", "node").mapInArrow(confirmed, "a bigint, b bigint").distinct()


def distinct_sets(marked: DataFrame) -> DataFrame:
    """One row for each set: its node (smallest doc_id), the row that stands for it, and its rows' number.

    A set whose rows all lack a doc_id gets a large node number of its own.
    """
    stands = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body")
    sets = marked.groupBy("key").agg(F.min(stands).alias("r"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("value").alias("value"),
                                     F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned(F.xxhash64("key"), 2)
    return sets.select("key", F.coalesce("r.doc_id", nameless).alias("node"), "r.doc_id", "r.body", "n", "size", "value", "bits", "bands")


def _one_document(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between the sets of rows that share a doc_id."""
    rows = marked.where("doc_id IS NOT NULL AND size > 0").select("doc_id", "key")
    several = rows.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    return rows.join(several, "doc_id").distinct().join(sets.select("key", "node"), "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _looked_up(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``sets`` (key, n, ...); sets of very many rows are spread over salts."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    hot = [bytes(r.key) for r in sets.where(F.col("n") >= max(1000, _HOT_SHARE * total)).select("key").collect()]      # at most 1000
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int")
    left = rows.withColumn("salt", F.when(F.col("key").isin(hot), salt).otherwise(0) if hot else F.lit(0))
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    right = sets.withColumn("salt", F.explode(F.when(F.col("key").isin(hot), salts).otherwise(F.array(F.lit(0)))) if hot else F.lit(0))
    return left.join(right.drop("n"), ["key", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), proposed: Callable[[DataFrame], DataFrame] | None = None,
                    mark: Callable[[np.ndarray], int] | None = None, empty_linked: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    component_id is the smallest doc_id that links reach, its own included. Texts without words
    have an empty set and are linked with nothing (with ``empty_linked``, with each other); a
    text of fewer words than a shingle is one shingle. Rows of one doc_id are one document, so what
    either text is linked with is linked; rows of NULL doc_id take part, but never name a
    component (NULL for one of only such rows); an empty table gives no rows; other columns are
    not read. ``proposed`` may give further candidate edges ``(a, b)`` of nodes, from the table of
    sets with the ``mark`` of each as ``value``.
    """
    marked = stored(_marked(docs, like, mark), "marked")
    sets = stored(distinct_sets(marked), "sets")
    full = sets.where("size > 0")
    edges = candidate_edges(full, like)
    if proposed is not None:
        edges = edges.unionByName(proposed(full))
    groups = components(edges)
    links = components(true_links(docs, full, groups, like).unionByName(_one_document(marked, full)))
    named = sets.join(links, "node", "left").select("key", "n", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    out = _looked_up(marked.select("doc_id", "key"), named)
    whole = F.when(F.col("component") >= _NAMELESS, F.lit(None)).otherwise(F.col("component"))
    if not empty_linked:
        whole = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(whole)
    out = out.select("doc_id", "n_shingles", whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
