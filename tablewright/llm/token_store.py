"""Operator 6: token files of directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those that need one, and so on; a bitmap on each level
marks the ids that go on, with a directory of counts for each 512 bits. Any id is read by one
rank for each level, without decoding what stands before it.

A token file is a Parquet folder of segments (consecutive documents of one key range): their
doc_ids, lengths and one code block. Spark's writer commits it, on any file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.bpe import encoder
from tablewright.llm.common import Ranges, partitions, plain_text, slices
from tablewright.session import scratch_path

CHUNK_BITS = 8
END_ID = 2
SEGMENT_TOKENS = 1 << 18
_RANK_BITS = 512
_MAGIC = b"DAC1"


def encode_codes(ids: np.ndarray) -> bytes:
    """The code block of unsigned ids below 2**32."""
    left = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while True:
        chunk = (left & np.uint32(255)).astype(np.uint8).tobytes()
        more = left > np.uint32(255)
        if not more.any():
            levels.append((len(left), chunk, b"", b""))
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(left) // _RANK_BITS) * (_RANK_BITS // 8), np.uint8)
        padded[:len(bits)] = bits
        ones = np.bitwise_count(padded.reshape(-1, _RANK_BITS // 8)).sum(1, dtype=np.uint64)
        directory = np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u4")
        levels.append((len(left), chunk, bits.tobytes(), directory.tobytes()))
        left = left[more] >> np.uint32(CHUNK_BITS)
    head = _MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<IIII", n, len(c), len(b), len(d)) for n, c, b, d in levels)
    return head + b"".join(c + b + d for _, c, b, d in levels)


class Codes:
    """Read access to a code block."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a code block")
        (count,) = struct.unpack_from("<I", data, 4)
        at = 8 + 16 * count
        self.levels = []
        for k in range(count):
            n, c, b, d = struct.unpack_from("<IIII", data, 8 + 16 * k)
            self.levels.append((n, np.frombuffer(data, np.uint8, c, at), np.frombuffer(data, np.uint8, b, at + c), np.frombuffer(data, "<u4", d // 4, at + c + b)))
            at += c + b + d
        self.length = self.levels[0][0]

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, at: int) -> int:
        """Set bits before place ``at``."""
        block = min(at // _RANK_BITS, len(directory) - 1)
        first = block * (_RANK_BITS // 8)
        whole = int(np.bitwise_count(bits[first:at // 8]).sum())
        rest = int(bits[at // 8] & ((1 << (at % 8)) - 1)).bit_count() if at % 8 else 0
        return int(directory[block]) + whole + rest

    def get(self, at: int) -> int:
        """One id, wherever it stands."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        value = shift = 0
        for _, chunk, bits, directory in self.levels:
            value |= int(chunk[at]) << shift
            if not len(bits) or not bits[at // 8] >> (at % 8) & 1:
                break
            at = self._rank(bits, directory, at)
            shift += CHUNK_BITS
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of ``start..stop-1``; nothing outside is read but two directory entries a level."""
        value = np.zeros(stop - start, np.uint32)
        rows, shift = np.arange(stop - start), 0
        for _, chunk, bits, directory in self.levels:
            value[rows] |= chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            if not len(bits) or start == stop:
                break
            more = np.unpackbits(bits[start // 8:-(-stop // 8)], bitorder="little")[start % 8:start % 8 + stop - start].astype(bool)
            rows, shift = rows[more], shift + CHUNK_BITS
            start = self._rank(bits, directory, start)
            stop = start + len(rows)
        return value


_SEGMENT = "range int, segment bigint, n_docs int, n_tokens bigint, before bigint, doc_ids binary, null_ids binary, lengths binary, codes binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Write every document's ids and an end id to a token file; returns ``path``.

    Documents are in ascending doc_id (NULL first), repeated ids by text; a NULL text has only
    its end id. A segment takes whole documents up to ``segment_tokens``, a longer one alone.
    An empty table makes an empty file. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = partitions(docs.sparkSession)
    ranges = Ranges(source, key, 2 * n)
    dealt = source.withColumn("range", ranges.number(key)).repartition(n, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        held: list[tuple] = []
        size, place, number, before = 0, None, 0, 0

        def flush():
            ids = [d for d, _ in held]
            lengths = np.array([len(x) // 4 for _, x in held], "<u4")
            yield pa.RecordBatch.from_pydict({
                "range": pa.array([place], pa.int32()), "segment": [number], "n_docs": pa.array([len(held)], pa.int32()), "n_tokens": [int(lengths.sum(dtype=np.int64))], "before": [before],
                "doc_ids": [np.array([d or 0 for d in ids], "<i8").tobytes()], "null_ids": [np.array([d is None for d in ids]).tobytes()],
                "lengths": [lengths.tobytes()], "codes": [encode_codes(np.frombuffer(b"".join(x for _, x in held), "<u4"))]})

        for batch in batches:
            docs_, texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for start, stop in slices(texts):
                for doc, ids, r in zip(docs_[start:stop], coder.encode(texts[start:stop]), places[start:stop]):
                    if held and (r != place or size + len(ids) // 4 >= segment_tokens):
                        yield from flush()
                        held, before, size, number = [], before + size, 0, number + 1
                    if r != place:
                        place, number, before = r, 0, 0
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
        if held:
            yield from flush()

    dealt.mapInArrow(segments, _SEGMENT).write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a token file.

    start counts the ids of all documents before it.
    """
    file = spark.read.schema(_SEGMENT).parquet(path)
    totals = sorted((r.range, r.n) for r in file.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect())
    before, base = 0, {}
    for r, count in totals:
        base[r] = before
        before += count
    if not base:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    begin = F.create_map(*(F.lit(v) for pair in base.items() for v in pair))[F.col("range")].cast("bigint")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, nulls, lengths, codes, start = (batch.column(c)[row].as_py() for c in range(5))
                block = Codes(codes)
                ids, nulls, lengths = np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                held = memoryview(block.slice(0, block.length).astype("<u4").tobytes())
                crc = [zlib.crc32(held[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=nulls), "start": pa.array(ends - lengths + start, pa.int64()),
                                                  "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    placed = file.select("doc_ids", "null_ids", "lengths", "codes", (begin + F.col("before")).alias("begin"))
    return placed.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_at(spark: SparkSession, path: str, range_: int, segment: int, place: int) -> int:
    """One id by its address: a single segment row is fetched, nothing in it is decoded."""
    row = spark.read.schema(_SEGMENT).parquet(path).where((F.col("range") == range_) & (F.col("segment") == segment)).select("codes").first()
    return Codes(bytes(row.codes)).get(place)


def store_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Round trip through a token file in the shared folder."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, scratch_path(docs.sparkSession, "tokens")))
