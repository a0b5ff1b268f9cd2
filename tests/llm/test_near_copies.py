"""The pipeline's near-copy stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from tablewright.llm import minhash, near_copies


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, label = [shingles(t or "") for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    return {d: least[x] for (d, _), x in zip(rows, label)}


def test_all_pairs_of_enough_similarity(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    passage = rnd.choices(words, k=60)
    texts = ["", None, "one", "One", "two words"]
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([6, 30, 200])) + rnd.choice([[], passage])
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6):                       # about 0.95 down to 0.7 at 200 words
            copy = list(base)
            for at in rnd.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "new" + rnd.choice(words)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stage_drops_copies_of_many_bits(spark):
    """Documents 1 and 177 have a similarity of 0.83 and fingerprints nine bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 177)")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert [r.doc_id for r in kept.collect()] == [1]


def test_no_pairs_around_one_passage(spark, monkeypatch):
    """2000 texts of one passage and own words, about 0.7 alike: none is a copy and no link is tried in vain."""
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(150)]
    rows = [(i, " ".join(passage + [f"o{rnd.randrange(10 ** 9)}" for _ in range(30)])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    edges = []
    whole = minhash.true_links
    monkeypatch.setattr(minhash, "true_links", lambda *a: edges.append(whole(*a)) or edges[0])
    got = near_copies.near_copies(docs).collect()
    assert len(got) == 2000 and all(r.doc_id == r.component_id for r in got)
    assert edges[0].count() == 0


def test_nameless_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (9, text + " tail"), (9, text), (3, "one of a kind"), (3, "two of a kind differ"), (5, "Two of a kind DIFFER"), (None, "nobody"), (None, None), (12, ""), (11, " ")]
    docs = spark.createDataFrame([(*r, b"", "k", 1, 2, 3) for r in rows], "doc_id bigint, text string, body binary, key string, node int, value int, component_id int")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in near_copies.near_copies(docs).collect()))
    assert got == sorted([(0, 9), (9, 9), (9, 9), (3, 3), (3, 3), (5, 3), (0, 0), (0, 11), (12, 11), (11, 11)])
