"""Operator 2: BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of a word's tree hold ``rank * size + position`` of each adjacent pair; the root is
the leftmost pair of lowest rank. A merge rewrites three leaves, each with a logarithmic walk
to the root, until no pair can merge. Many words run side by side as rows of one NumPy array.
A word's ids depend on the word alone, so finished words are remembered (bounded, two
generations) and a text costs one look-up for each word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import compress, count
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import plain_text, slices

#: Entries of one generation of remembered words; at most two generations are held.
CACHE_ENTRIES = 400_000
_NONE = np.int64(1) << 62
#: Bytes of words (with padding) that one array of trees holds; it stays in the processor's cache.
_SIDE_BY_SIDE = 1 << 16
#: Odd multiplier that spreads pairs over the hash table.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space to Python but not to Unicode's property: texts with them take the slow way.
_ODD = re.compile("[\x1c-\x1f]")
_DOUBLE = re.compile(r"\s\s")
#: ASCII punctuation that never joins the letters before it; a run of it is one word.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in kept}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class PairTree:
    """Merge tables and the side-by-side segment trees."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash(np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64))
        one, two = np.divmod(np.arange(1 << 16), 256)
        self.inner_rank = self.ranks(self.first[one], self.first[two])
        self.last_rank = self.ranks(self.first[one], self.last[two])

    def _hash(self, keys: np.ndarray) -> None:
        """An open table from pair to rank, at most a quarter full."""
        bits = max(2, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, -1, np.int64)
        rank, at = np.arange(len(keys)), self._home(keys)
        while len(rank):
            free = np.flatnonzero(self.slot_key[at] < 0)
            own = free[np.unique(at[free], return_index=True)[1]]
            self.slot_key[at[own]], self.slot_rank[at[own]] = keys[rank[own]], rank[own]
            rank, at = np.delete(rank, own), (np.delete(at, own) + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it cannot merge."""
        key = (left << 32) | right
        at = self._home(key)
        found = self.slot_key[at]
        same = found == key
        rank = np.where(same, self.slot_rank[at], -1)
        others = np.flatnonzero(~same & (found >= 0))
        while len(others):
            at = (at if len(at) == len(others) else at[others]) + 1 & self.mask
            found, wanted = self.slot_key[at], key[others]
            same = found == wanted
            rank[others[same]] = self.slot_rank[at[same]]
            on = ~same & (found >= 0)
            others, at = others[on], at[on]
        return rank

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of each non-empty word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([max(2, 1 << (len(w) - 1).bit_length()) for w in words], np.int64)
        for size in np.unique(sizes):
            where = np.flatnonzero(sizes == size).tolist()
            step = max(1, _SIDE_BY_SIDE // int(size))
            for i in range(0, len(where), step):
                part = where[i:i + step]
                for k, ids in zip(part, self._same_size([words[k] for k in part], int(size))):
                    out[k] = ids
        return out

    def _same_size(self, words: list[bytes], size: int) -> list[bytes]:
        n, log = len(words), size.bit_length() - 1
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(n, size)
        rows, place = np.arange(n), np.arange(size)
        inside = place < length[:, None]
        symbols = self.first[data]
        symbols[rows, length - 1] = self.last[data[rows, length - 1]]
        pair = (data[:, :-1].astype(np.int32) << 8) | data[:, 1:]
        rank = self.inner_rank[pair]
        long = np.flatnonzero(length > 1)
        rank[long, length[long] - 2] = self.last_rank[pair[long, length[long] - 2]]
        trees = np.full((n, 2 * size), _NONE)
        trees[:, size:2 * size - 1] = np.where((rank >= 0) & inside[:, 1:], (rank << log) + place[:-1], _NONE)
        width = size
        while width > 1:
            half = width // 2
            trees[:, half:width] = np.minimum(trees[:, width:2 * width:2], trees[:, width + 1:2 * width:2])
            width = half

        # Flat views from here on: a word's leaves start at row * size, its tree at twice that.
        tree, symbol, alive = trees.ravel(), symbols.ravel(), inside.ravel()
        after = np.where(inside[:, 1:], place[1:], size)
        after = np.concatenate([after, np.full((n, 1), size)], 1).ravel()
        before = np.tile(place - 1, n)
        start = rows[trees[:, 1] < _NONE] * size
        while len(start):
            root = tree[2 * start + 1]
            at, new = root & (size - 1), self.made[root >> log]
            here = start + at
            gone = after[here]
            then = after[start + gone]
            left = before[here]
            symbol[here], after[here], alive[start + gone] = new, then, False
            right_of, left_of = np.flatnonzero(then < size), np.flatnonzero(left >= 0)
            following = start[right_of] + then[right_of]
            before[following] = at[right_of]
            rank = self.ranks(np.concatenate([new[right_of], symbol[start[left_of] + left[left_of]]]),
                              np.concatenate([symbol[following], new[left_of]]))
            leaf = np.concatenate([at[right_of], left[left_of]])
            value = np.where(rank >= 0, (rank << log) + leaf, _NONE)
            # The three leaves that change; their walks to the root go up level by level together.
            top = 2 * start
            tree[top + size + gone] = _NONE
            tree[top + size + at] = _NONE
            tree[2 * start[np.concatenate([right_of, left_of])] + size + leaf] = value
            base = np.concatenate([top, top, top[left_of]])
            node = np.concatenate([at, gone, left[left_of]]) + size
            for _ in range(log):
                here = base + node
                node >>= 1
                tree[base + node] = np.minimum(tree[here], tree[here ^ 1])
            start = start[tree[top + 1] < _NONE]
        ids, ends = symbol[alive].astype("<u4").tobytes(), np.cumsum(4 * inside.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Ids and texts of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.tree = PairTree(model["vocab"], model["merges"], suffix)
        self.words = bool(suffix)           # lower case, white space dropped
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.spaced = spec["decoder"] is None
        letters = {c: b for b, c in enumerate(byte_letters())}
        plain = (lambda t: t.encode()) if self.spaced else (lambda t: t.encode() if t in self.special else bytes(letters[c] for c in t))
        self.raw = [plain(self.tokens[i]) for i in range(max(self.tokens) + 1)]
        self.on_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.words else _BYTE_SPLIT
        self.split = regex.compile(split)
        self.special_ids = {t: int(i).to_bytes(4, "little") for t, i in self.special.items()}
        self.pieces: dict[str, bytes] = dict(self.special_ids)
        self.older: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text without special tokens; each piece has its ids, whatever stands beside it."""
        if self.words:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            return self.split.findall(text) if _ODD.search(text) else text.split()
        if _DOUBLE.search(text) or _ODD.search(text):
            return self.split.findall(text)
        pieces = text.replace(" ", "\x1f ").split("\x1f")       # the text holds no \x1f of its own
        return pieces if pieces[0] else pieces[1:]

    def _parts(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._cut(text)
        out: list[str] = []
        for i, part in enumerate(self.on_special.split(text)):
            out.extend([part] if i % 2 else self._cut(part))        # a cut piece is never a special token
        return out

    def _learn(self, missing: set[str]) -> None:
        """Ids of new pieces into ``pieces``, which makes room by dropping its older generation."""
        if len(self.pieces) + len(missing) > CACHE_ENTRIES:
            self.older, self.pieces = self.pieces, dict(self.special_ids)
        missing = missing - self._recall(missing)
        plain: set[str] = set()
        words: dict[str, list[str] | tuple[str, str]] = {}
        for p in missing:
            body = p.rstrip(_MARKS)
            if not body.removeprefix(" ").isalpha():
                words[p] = self.split.findall(p)
            elif len(body) < len(p):
                words[p] = body, p[len(body):]
            else:
                plain.add(p)
        known = self.pieces
        inner = {w for ws in words.values() for w in ws if w not in known}
        fresh = list(plain | inner - self._recall(inner))
        known.update(zip(fresh, self.tree.encode([w.encode() for w in fresh])))
        known.update((p, b"".join([known[w] for w in ws])) for p, ws in words.items() if len(ws) > 1)

    def _recall(self, pieces: set[str]) -> set[str]:
        """Those of the older generation, which are new again."""
        found = pieces & self.older.keys()
        self.pieces.update(zip(found, map(self.older.__getitem__, found)))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start, stop in slices(texts):
            parts = [self._parts(t) for t in texts[start:stop]]
            ids = [list(map(self.pieces.get, p)) for p in parts]
            gaps = [(p, v, list(compress(count(), map(not_, v)))) for p, v in zip(parts, ids) if None in v]
            if gaps:
                self._learn({p[k] for p, _, at in gaps for k in at})
            known = self.pieces
            for p, v, at in gaps:
                for k in at:
                    v[k] = known[p[k]]
            out.extend(map(b"".join, ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        tokens = map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return (b" " if self.spaced else b"").join(tokens).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``(key, n_tokens, ids BINARY[, decoded STRING])`` for each row, in no certain order.

    ids are little-endian unsigned 32-bit integers. A NULL text counts as empty and has no
    ids; the key may be NULL or repeated, and other columns are not read. An unknown file
    raises. ``tokenizer`` must be readable at the same path on every executor.
    """
    source = docs.select(F.col(key).alias("key"), plain_text(text).alias("text"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                ids = coder.encode(texts[start:stop])
                columns = {"key": keys.slice(start, stop - start), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([coder.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"key {kind.simpleString()}, n_tokens bigint, ids binary" + (", decoded string" if decoded else "")
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; NULL ids give NULL. An id outside the vocabulary raises."""

    @F.pandas_udf("string")
    def text(packed):
        coder = encoder(tokenizer)
        return packed.map(lambda x: None if x is None else coder.decode(bytes(x)))

    return encoded.withColumn(out, text(F.col(ids)))


def encoding_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digest columns of ``encode`` with the decoded text."""
    out = encode(docs, tokenizer, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
