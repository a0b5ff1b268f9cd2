"""Operator 12: the prefix trie of conversations, worked out on padded turn-id matrices.

Equal turn sequences are counted as one row first. Rows are range-sharded in the order of their
turn ids; a shard sorts its padded id matrix with ``lexsort``, marks where each column differs
from the row above and accumulates the marks by OR along the row: a mark is the start of a node.
``reduceat`` over the starts of one column gives all nodes of that depth.

Every figure of a node is a sum or minimum over its rows, if each row knows what it shares with
its neighbours in the whole order. So a shard also holds the last row before and the first row
after it; nodes that such a guest belongs to are the only ones that may go on in another shard,
and their parts are added up by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import partitions, plain_text, stored

#: Columns of one matrix; longer rows go on in further matrices that hold only them.
COLUMNS = 64
#: Rows of a shard, on average; a parameter of balance that never changes a result.
SHARD_ROWS = 200_000
#: Conversation numbers joined into one piece of text before the digest of a node's ends.
ENDS_RANGE = 4096

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_BLANK = r"[\x20\x09-\x0D]+"
_NODES = ("node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, "
          "n_leaves bigint, saved_tokens bigint, ends_sha256 string, open boolean")


def n_words(text: Column) -> Column:
    """Words of maximal non-blank characters; only space and the controls 9 to 13 are blank."""
    return F.size(F.filter(F.split(text, _BLANK), lambda w: w != "")).cast("int")


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: ordered ``array<struct<id: 8 bytes, words>>`` of each conversation.

    Ordered by turn, NULL first, ties by a digest of role and text.
    """
    role, text = plain_text("role"), plain_text("text")
    digest = F.md5(F.concat(F.length(role), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), n_words(text).alias("words")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    brief = F.transform(ordered, lambda t: F.struct(F.unhex(F.substring(t["digest"], 1, 16)).alias("id"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(brief.alias("turns"))


def rebuilt(held: DataFrame, share: int = 20, head: int = 4) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its ``share`` numbers."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    source = F.col("conv_id") - F.col("conv_id") % share
    heads = held.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("source"), F.slice("turns", 1, head - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    own = F.slice(F.col("turns"), h + 1, F.size("turns"))
    return held.withColumn("source", source).join(heads, "source", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice(F.col("head"), F.lit(1), h), none), own).alias("turns"))


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order: no key's pieces are held together."""
    key, digest = None, None
    for batch in batches:
        keys, ends = [], []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                digest.update(b"," + piece.encode())
                continue
            if key is not None:
                keys.append(key)
                ends.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(piece.encode())
        if keys:
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends": ends})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [digest.hexdigest()]})


def classes(rows: DataFrame) -> DataFrame:
    """``(seq, words, n, first, ends)``: one row for each distinct sequence of turns.

    seq is its turn ids end to end, words their 32-bit word counts, ends the digest of the
    conversation numbers. Numbers are joined in pieces of bounded ranges before they meet.
    """
    n = partitions(rows.sparkSession)
    seq = F.concat(F.lit(b""), F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    words = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["words"]), 8, "0")), "")
    flat = rows.select("conv_id", F.unhex(seq).alias("seq"), F.unhex(words).alias("words"))
    flat = flat.withColumn("key", F.unhex(F.md5("seq")))
    sums = flat.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    at = F.floor(F.col("conv_id") / ENDS_RANGE)
    pieces = flat.groupBy("key", at.alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    ordered = pieces.repartition(n, "key").sortWithinPartitions("key", "at").select("key", "piece")
    ends = ordered.mapInArrow(_ends_digests, "key binary, ends string")
    return sums.join(ends, "key").drop("key")


def _with_guests(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt to ``n`` ranges of ``seq``, each with its neighbours at both sides (guest -1 and 1)."""
    dealt = stored(rows.repartitionByRange(n, "seq").withColumn("shard", F.spark_partition_id()), "trie")
    whole = F.struct("seq", "words", "n", "first", "ends")
    edges = dealt.groupBy("shard").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    order = Window.orderBy("shard")                                      # one row for each shard
    guests = edges.select("shard", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    guests = guests.select("shard", F.explode(F.array(
        F.struct(F.lit(-1).alias("guest"), F.col("before").alias("row")), F.struct(F.lit(1).alias("guest"), F.col("after").alias("row")))).alias("g"))
    guests = guests.where("g.row IS NOT NULL").select("shard", "g.guest", "g.row.*")
    return dealt.withColumn("guest", F.lit(0)).unionByName(guests).select("shard", "guest", "seq", "words", "n", "first", "ends")


def _matrix(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """Padded id matrix of the columns from ``at`` on, for rows longer than that; zero is the pad."""
    column = at + np.arange(int(min(COLUMNS, length.max() - at)))
    inside = column[None] < length[:, None]
    return np.where(inside, flat[np.where(inside, start[:, None] + column[None], 0)], np.uint64(0))


def _sorted(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Row order by turn ids, column by column; a sequence comes before those that go on from it."""
    order, group = np.argsort(length > 0, kind="stable"), np.zeros(len(length), np.int64)
    for at in range(0, int(length.max()), COLUMNS):
        places = np.flatnonzero(length[order] > at)                       # rows that go on, in order so far
        alive = order[places]
        matrix = _matrix(flat, start[alive], length[alive], at)
        inner = np.lexsort((length[alive] > at + COLUMNS, *matrix.T[::-1], group[alive]))
        matrix, alive = matrix[inner], alive[inner]
        new = np.concatenate(([True], (matrix[1:] != matrix[:-1]).any(1) | (group[alive[1:]] != group[alive[:-1]])))
        order[places] = alive
        group[alive] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return order


def _shared(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the row above it (0 for the first row)."""
    shared = np.zeros(len(length), np.int64)
    rows, at = np.arange(1, len(length)), 0
    while len(rows := rows[np.minimum(length[rows], length[rows - 1]) > at]):
        both = np.minimum(length[rows], length[rows - 1])
        matrix = [_matrix(flat, start[r], both, at) for r in (rows - 1, rows)]
        changed = np.logical_or.accumulate((matrix[0] != matrix[1]) | (matrix[0] == 0), axis=1)
        same = (~changed).sum(1)
        shared[rows] = at + same
        rows = rows[same == COLUMNS]
        at += COLUMNS
    return shared


def _next_keys(key: np.ndarray, turn: np.ndarray, depth: int) -> np.ndarray:
    """Digests (two words each) of prefixes that go on with a turn."""
    out = np.empty_like(key)
    with np.errstate(over="ignore"):
        for lane, odd in enumerate((np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))):
            x = (key[:, lane] ^ turn) * odd
            x ^= x >> np.uint64(29)
            out[:, lane] = (x + turn) * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(32)) ^ np.uint64(depth)
    return out


def _shard_nodes(guest: np.ndarray, seqs: list[bytes], words: list[bytes], n: np.ndarray, first: np.ndarray, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard, depth by depth: columns as in ``_NODES``."""
    length = np.fromiter(map(len, seqs), np.int64, len(seqs)) // 8
    flat = np.frombuffer(b"".join(seqs) or bytes(8), ">u8").astype(np.uint64)
    flat = np.where(flat == 0, np.uint64(1), flat)                         # zero is the pad
    total = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(words) or bytes(4), ">u4").astype(np.int64))))
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    order = _sorted(flat, start, length)
    start, length, first, own = start[order], length[order], first[order], guest[order] == 0
    shared = _shared(flat, start, length)
    leaf = own & (np.concatenate((shared[1:], [-1])) < length)             # no sequence goes on from this one
    counted = np.where(own, n[order], 0)
    least = np.where(own, first, np.iinfo(np.int64).max)
    key = np.tile(np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]], np.uint64), (len(order), 1))
    above = key.copy()
    depth, alive = 0, np.arange(len(order))
    while len(alive):
        begin = np.flatnonzero(np.concatenate(([True], shared[alive[1:]] < depth)))
        size = length[alive]
        # Words from this depth on: all copies of a row, less those that begin a node of their own.
        base, top = start[alive] + max(0, depth - 1), total[start[alive] + size]
        begun = np.maximum(base, start[alive] + shared[alive])
        saved = np.where(own[alive], counted[alive] * (top - total[base]) - (top - total[begun]), 0)
        child = own[alive] & (size > depth) & (shared[alive] <= depth)
        ender = np.maximum.reduceat(np.where(own[alive] & (size == depth), np.arange(len(alive)), -1), begin)
        owned = np.add.reduceat(own[alive].astype(np.int64), begin)
        rows = np.diff(np.concatenate((begin, [len(alive)])))
        kept = np.flatnonzero(owned)
        head = alive[begin[kept]]
        sums = {name: np.add.reduceat(v.astype(np.int64), begin)[kept] for name, v in (
            ("n_convs", counted[alive]), ("n_children", child), ("n_leaves", leaf[alive]), ("saved_tokens", saved))}
        yield pa.RecordBatch.from_pydict({
            "node": pa.array([k.tobytes() for k in key[head]], pa.binary()),
            "parent": pa.array([k.tobytes() if depth else None for k in above[head]], pa.binary()),
            "depth": np.full(len(kept), depth), "conv_id": np.minimum.reduceat(least[alive], begin)[kept], **sums,
            "ends_sha256": pa.array([ends[order[alive[e]]] if e >= 0 else None for e in ender[kept].tolist()], pa.string()),
            "open": (owned < rows)[kept]})
        alive = alive[size > depth]
        depth += 1
        above[alive] = key[alive]
        key[alive] = _next_keys(key[alive], flat[start[alive] + depth - 1], depth)


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 8192) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        guest, n, first = (t.column(c).to_numpy() for c in ("guest", "n", "first"))
        seqs, words, ends = (t.column(c).to_pylist() for c in ("seq", "words", "ends"))
        return _gathered(_shard_nodes(guest, seqs, words, n, first, ends))

    shard, parts = None, []
    for batch in batches:                                                  # sorted by shard
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if parts and shards[lo] != shard:
                yield from done(parts)
                parts = []
            shard = shards[lo]
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield from done(parts)


def trie(turns: DataFrame, share: int = 20, head: int = 4) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the root included.

    Columns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. A NULL role or text is empty; rows of NULL conv_id take no part; repeated rows
    are repeated turns; an empty table gives no rows; other columns are not read. One
    conversation's turn ids (12 bytes a turn) meet in one row, whatever its length.
    """
    spark = turns.sparkSession
    rows = stored(classes(rebuilt(sequences(turns), share, head)), "sequences")
    least = min(partitions(spark), spark.sparkContext.defaultParallelism)
    sharded = _with_guests(rows, max(least, -(-rows.count() // SHARD_ROWS)))
    found = stored(sharded.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(_nodes, _NODES), "nodes")
    names = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where("open").groupBy("node", "parent").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in names[2:]], F.max("ends_sha256").alias("ends_sha256"))
    joined = found.where("NOT open").select("node", "parent", *names, "ends_sha256").unionByName(parts.select("node", "parent", *names, "ends_sha256"))
    parents = joined.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return joined.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", *names[2:], F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
