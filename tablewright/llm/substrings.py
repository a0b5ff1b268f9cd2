"""Operator 4: substring dedup by winnowed anchors, extended to maximal repeats.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash of the word five-grams
inside it, so equal windows have equal anchors: documents are joined on anchors, and only
windows whose anchor several documents share go on. Extending an anchor both ways over all
places where it can stand in a window is done for all documents at once, by joining the
windows themselves on a hash of their words; overlapping repeated windows then form maximal
runs. Documents live in buckets of bounded text; a bucket sends each anchor and window once,
so a passage shared by very many documents is a few rows for each bucket, never pairs.
Windows are compared by 64-bit hashes, within windows of equal 64-bit anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tablewright.llm.common import partitions, plain_text

WINDOW = 13
ANCHOR_WORDS = 5
#: Text of one bucket, in code points; a longer single text is a bucket's whole content.
BUCKET_CHARS = 4_000_000

_A = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


_FINE = _power(0xD6E8FEB86659FD93, 4096)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Word, anchor and window hashes of several texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])) if len(texts) else np.zeros(0, np.int64)
        n = len(starts)
        with np.errstate(over="ignore"):
            if n:
                length = ends - starts
                step = np.arange(len(data), dtype=np.int64)[~blank] - np.repeat(starts, length)
                code = _CODE[data[~blank]] * _FINE[step & 4095]
                if int(length.max()) > 4096:
                    code *= _power(0xA0761D6478BD642F, int(length.max()) // 4096 + 1)[step >> 12]
                word = _mixed(np.add.reduceat(code, np.concatenate(([0], np.cumsum(length)[:-1]))) + length.astype(np.uint64))
            else:
                word = np.zeros(0, np.uint64)
            m = n - WINDOW + 1
            if m <= 0:
                self.at = np.zeros(0, np.int64)
                self.anchor = self.window = np.zeros(0, np.int64)
                return
            powers = [np.uint64(pow(_A, k, 1 << 64)) for k in range(WINDOW)]
            two = word[:-1] + powers[1] * word[1:]
            four = two[:-2] + powers[2] * two[2:]
            eight = four[:-4] + powers[4] * four[4:]
            gram = _mixed(four[:-1] + powers[4] * word[4:])                    # five words
            window = eight[:m] + powers[8] * four[8:8 + m] + powers[12] * word[12:12 + m]
        low = np.minimum(gram[:-1], gram[1:])
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-4], low[4:])
        anchor = np.minimum(low[:m], gram[8:8 + m])
        self.at = np.flatnonzero(self.owner[:m] == self.owner[WINDOW - 1:])
        with np.errstate(over="ignore"):
            self.anchor = anchor[self.at].view(np.int64)
            self.window = _mixed(window[self.at]).view(np.int64)


def _inside(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and UTF-8 texts of a bucket."""
    texts = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    return table.column("doc_id").to_numpy(), texts


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.sort(table.column(name).to_numpy())


def _anchors(table: pa.Table) -> pa.Table:
    ids, texts = _texts(table)
    found = np.unique(Words(texts).anchor)
    return pa.table({"anchor": found, "bucket": np.full(len(found), table.column("bucket")[0].as_py() if len(ids) else 0, np.int64)})


def _windows(table: pa.Table, shared: pa.Table) -> pa.Table:
    """Windows with a shared anchor, each once, with the bucket's smallest document."""
    ids, texts = _texts(table)
    words = Words(texts)
    kept = _inside(words.anchor, _column(shared, "anchor"))
    window, doc = words.window[kept], ids[words.owner[words.at[kept]]]
    order = np.lexsort((doc, window))
    window, doc = window[order], doc[order]
    new = np.concatenate(([True], window[1:] != window[:-1]))[:len(window)]
    bucket = table.column("bucket")[0].as_py() if len(ids) else 0
    return pa.table({"window": window[new], "first": doc[new].astype(np.int64), "bucket": np.full(int(new.sum()), bucket, np.int64)})


def _kept(table: pa.Table, earlier: pa.Table, whole: bool) -> pa.Table:
    """Texts without words that stand in an earlier document's window; ``whole`` leaves others as they were."""
    ids, texts = _texts(table)
    words = Words(texts)
    doc = ids[words.owner[words.at]] if len(words.at) else np.zeros(0, np.int64)
    order = np.lexsort((doc, words.window))
    window, owner = words.window[order], doc[order]
    new = np.concatenate(([True], window[1:] != window[:-1]))[:len(window)]
    least = owner[new][np.cumsum(new) - 1] if len(window) else owner
    gone = np.zeros(len(window), bool)
    gone[order] = least < owner
    gone |= _inside(words.window, _column(earlier, "window"))
    total = int(words.count.sum())
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, words.at[gone], 1)
    np.add.at(cover, np.minimum(words.at[gone] + WINDOW, total), -1)
    removed = np.cumsum(cover)[:total] > 0
    out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "text": [], "spans": []}
    for k, text in enumerate(texts):
        first, n = int(words.first[k]), int(words.count[k])
        mask = removed[first:first + n]
        cut = int(mask.sum())
        pieces = text.split() if cut or not whole else [text]
        if cut:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            spans = [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
            pieces = [w for w, x in zip(pieces, mask.tolist()) if not x]
        out["doc_id"].append(int(ids[k]))
        out["n_words"].append(n)
        out["n_removed"].append(cut)
        out["text"].append(b" ".join(pieces).decode("utf-8", "surrogatepass"))
        out["spans"].append(spans if cut else [])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string(), "spans": spans_type}
    made = pa.table({name: pa.array(out[name], kind) for name, kind in types.items()})
    return made.append_column("rest", table.column("rest")) if "rest" in table.column_names else made


def _runs(column: str, emit):
    """A ``mapInArrow`` function over rows sorted by a key; ``emit`` sees only whole runs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if not held.num_rows:
                continue
            keys = held.column(column).to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))
            if done:
                yield from emit(held.slice(0, done)).to_batches()
                held = held.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held).to_batches()

    return run


def _of_several(table: pa.Table) -> pa.Table:
    """Rows of anchors that come from two buckets or more."""
    keys = table.column("anchor").to_numpy()
    same = keys[1:] == keys[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return table.filter(pa.array(keep)).select(["bucket", "anchor"])


def _later(table: pa.Table) -> pa.Table:
    """Windows whose bucket does not hold their first document of all."""
    keys, first = table.column("window").to_numpy(), table.column("first").to_numpy()
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    least = first[new][np.cumsum(new) - 1]
    return table.filter(pa.array(first > least)).select(["bucket", "window"])


def remove_repeats(docs: DataFrame, bucket_chars: int = BUCKET_CHARS, rest: list[str] | None = None, whole: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, text, spans[, rest])`` for every row.

    A word goes if a window of 13 words covers it whose word sequence also starts in a
    document of smaller doc_id, judged on the input. text holds the kept words joined by one
    space (with ``whole``, a text that loses nothing stays as it was), spans the removed runs
    as word ranges (start, end), rest a struct of the columns named by ``rest``. A NULL text
    has no words; a row of NULL doc_id neither loses words nor takes them from others; rows of
    equal doc_id do not take words from each other; an empty table gives no rows.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    extra = [F.struct(*rest).alias("rest")] if rest else []
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"), *extra)
    total = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(n, int(total // bucket_chars) + 1)
    placed = source.where("doc_id IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("bigint")).repartition(n, "bucket")
    anchors = placed.groupBy("bucket").applyInArrow(_anchors, "anchor bigint, bucket bigint")
    shared = anchors.repartition(n, "anchor").sortWithinPartitions("anchor", "bucket").mapInArrow(_runs("anchor", _of_several), "bucket bigint, anchor bigint")
    windows = placed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_windows, "window bigint, first bigint, bucket bigint")
    later = windows.repartition(n, "window").sortWithinPartitions("window", "first").mapInArrow(_runs("window", _later), "bucket bigint, window bigint")
    schema = StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, text string, spans array<struct<start:bigint,end:bigint>>")
    if rest:
        schema = StructType([*schema.fields, StructField("rest", source.schema["rest"].dataType)])

    def kept(table: pa.Table, earlier: pa.Table) -> pa.Table:
        return _kept(table, earlier, whole)

    out = placed.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(kept, schema)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    apart = source.where("doc_id IS NULL").select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"),
        F.col("text") if whole else F.array_join(words, " ").alias("text"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), *(["rest"] if rest else []))
    return out.unionByName(apart)
