"""b-bit MinHash near-duplicates against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from tablewright.llm import minhash
from tablewright.llm.minhash import Similarity


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=3, share=85, of_all=100):
    """doc_id -> (sizes, component); rows of one doc_id are one document."""
    sets, label = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def join(i, j):
        old, new = label[i], label[j]
        if old != new:
            label[:] = [new if x == old else x for x in label]

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b
            if same or (a and of_all * len(a & b) >= share * len(a | b)):
                join(i, j)
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return [(d, len(s), (d if not s else least.get(x)), d is not None and d == (d if not s else least.get(x))) for (d, _), s, x in zip(rows, sets, label)]


def varied(rnd, k):
    words = [f"w{i}" for i in range(3000)] + ["É", "Ab", "x" * 40]
    passage = rnd.choices(words, k=60)
    texts = ["", None, " \t", "one", "One", "two words", "two  WORDS", "words two", "a b c", "ab c"]
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([4, 6, 30, 200])) + rnd.choice([[], passage])
        texts += [" ".join(base), "\n".join(base).upper()]
        for changes in (1, 2, 3, 4, 5, 6, 8):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "new" + rnd.choice(words)
            texts.append(" ".join(copy))
    return texts


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


def test_against_all_pairs(spark):
    rnd = random.Random(2)
    rows = list(enumerate(varied(rnd, 3), 1))
    rnd.shuffle(rows)
    rows += [(None, rows[5][1]), (None, "only nameless rows say this"), (None, "only nameless rows say this"), rows[9], rows[9], (7, "another text of seven"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "k", b"", 3) for r in rows], "doc_id bigint, text string, node int, key string, body binary, size int").repartition(5)
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    """Small blocks of buckets and groups, a template with own words, and one group in a chain."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    template, chain = rnd.choices(words, k=200), rnd.choices(words, k=120)
    texts = [" ".join(template + rnd.choices(words, k=rnd.choice([8, 14, 30]))) for _ in range(80)]
    for i in range(80):
        chain[(i * 7) % 120] = f"c{i}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts, 1))
    want = sorted(brute(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 9)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("least", [Similarity(), Similarity(5, 4, 5, 4)])
def test_links_of_sets(least):
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(rnd.choice(pool, rnd.integers(1, 60))) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[rnd.random(len(s)) < 0.95], s[:1]))) for s in sets for _ in range(2)]
    x, y = minhash.linked_sets(sets, least)
    label = list(range(len(sets)))
    want = list(label)
    for i, j in zip(x.tolist(), y.tolist()):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert least.of_all * both >= least.share * (len(sets[i]) + len(sets[j]) - both)
        label = [label[i] if v == label[j] else v for v in label]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if least.of_all * both >= least.share * (len(a) + len(b) - both):
                want = [want[i] if v == want[j] else v for v in want]
    assert [label.index(v) for v in label] == [want.index(v) for v in want]
    assert len(x) == len(sets) - len(set(label))


def test_estimates_are_close():
    rnd = np.random.default_rng(5)
    for share in (0.7, 0.85, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        error = []
        for _ in range(20):
            all_ = rnd.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2)
            bits = minhash.packed_bits(minhash.minima([all_[:n], all_[n - both:]]))
            equal = minhash.equal_groups(bits[0], bits[1:])[0] / minhash.MINIMA
            error.append((equal - 0.25) / 0.75 - share)
        assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05
