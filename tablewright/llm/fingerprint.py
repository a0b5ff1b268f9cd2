"""Operator 1: document fingerprints by context-triggered piecewise hashing.

A rolling hash over eight bytes triggers a piece boundary where its low ``k`` bits are all
set; each piece gives one signature symbol. ``k`` is the smallest level with at most
``MOST_PIECES`` boundaries, so the whole text is covered and the signature stays short. Every
fingerprint holds the signatures of levels ``k`` and ``k + 1``; fingerprints of the same or of
neighbouring levels are compared by edit distance (insertions and deletions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Ranges, partitions, plain_text, rows_in_arrow

MOST_PIECES = 63
WINDOW = 8
_STEP = np.uint32(0x9E3779B1)
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A mixed 32-bit hash of the eight bytes that end at each place."""
    h = data.astype(np.uint32) + np.uint32(1)
    step = _STEP
    for back in (1, 2, 4):
        shifted = h[:-back] * step
        h = h.copy()
        h[back:] += shifted
        step = step * step
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _signature(h: np.ndarray, ends: np.ndarray) -> str:
    """Two letters for each piece; a tail after the last boundary is a piece too."""
    starts = np.concatenate(([0], ends + 1))
    starts = starts[starts < len(h)]
    with np.errstate(over="ignore"):
        piece = np.add.reduceat(h, starts, dtype=np.uint32) * np.uint32(0xC2B2AE35)
    code = piece >> np.uint32(20)
    return np.stack([_LETTERS[code >> 6], _LETTERS[code & 63]], 1).tobytes().decode()


def fingerprint_text(text: str) -> str:
    """``level:signature:signature`` of a whole text; an empty text gives ``0::``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "0::"
    with np.errstate(over="ignore"):
        h = _rolling(data)
    level = max(0, (len(data) // MOST_PIECES).bit_length() - 1)

    def ends(k: int, among: np.ndarray | None = None) -> np.ndarray:
        mask = np.uint32((1 << k) - 1)
        if among is None:
            return np.flatnonzero((h & mask) == mask)
        return among[(h[among] & mask) == mask]

    found = ends(level)
    while len(found) <= MOST_PIECES and level:
        lower = ends(level - 1)
        if len(lower) > MOST_PIECES:
            break
        level, found = level - 1, lower
    while len(found) > MOST_PIECES and level < 32:
        level += 1
        found = ends(level, found)
    if level == 32 and len(found) > MOST_PIECES:    # one hash value all over: boundaries say nothing
        found = found[:0]
    return f"{level}:{_signature(h, found)}:{_signature(h, ends(level + 1, found) if level < 32 else found)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two-letter symbols, bit-parallel."""
    places: dict[str, int] = {}
    for i in range(0, len(a), 2):
        s = a[i:i + 2]
        places[s] = places.get(s, 0) | (1 << (i // 2))
    n = len(a) // 2
    full = (1 << n) - 1
    row = full
    for i in range(0, len(b), 2):
        hit = row & places.get(b[i:i + 2], 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def likeness(left: str | None, right: str | None) -> float:
    """0 to 1: one less the edit distance over both lengths, best over compatible levels.

    Equal fingerprints are 1, levels more than one apart and a NULL on either side 0.
    """
    if left is None or right is None:
        return 0.0
    if left == right:
        return 1.0
    (ka, *a), (kb, *b) = left.split(":"), right.split(":")
    gap = int(ka) - int(kb)
    pairs = {0: ((a[0], b[0]), (a[1], b[1])), 1: ((a[0], b[1]),), -1: ((a[1], b[0]),)}.get(gap, ())
    return max((4.0 * _common(x, y) / (len(x) + len(y)) for x, y in pairs if x and y), default=0.0)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column; a NULL text counts as empty, no row is dropped."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint_text)

    return df.withColumn(out, of(plain_text(text)))


def compare(left: str | Column, right: str | Column) -> Column:
    """Likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def like(a, b):
        return a.combine(b, likeness)

    return like(left, right)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, likened to both neighbours.

    The edited text replaces the last ``floor(n / 2)`` code points by the first as many (or
    all) of the next document in ascending doc_id; after the last comes the first. NULL texts
    are empty; rows of NULL doc_id come first; repeated doc_ids follow each other by text; a
    single row is its own next. An empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = partitions(docs.sparkSession)
    ranges = Ranges(source, key, 2 * n)
    dealt = ranges.with_guests(source, key, before=False, after=True, ring=True)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None

        def done(held, follower):
            doc_id, text, fp = held
            half = len(text) // 2
            edited = text[:len(text) - half] + follower[1][:half]
            edited_fp = fingerprint_text(edited)
            return (doc_id, len(text), _digest(edited), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, follower[2]))

        for doc_id, text, own_range, guest in rows:
            if held is not None and held[0] == own_range:
                now = (doc_id, text, fingerprint_text(text))
                yield done(held[1], now)
                held = (own_range, now) if not guest else None
            elif not guest:
                held = (own_range, (doc_id, text, fingerprint_text(text)))

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    run = rows_in_arrow(pairs, schema, ["doc_id", "text", "range", "guest"])
    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
