"""Document operators against brute force and the tokenizers library, on edge tables too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import bpe, fingerprint, packing, simhash, substrings, token_store, toxicity
from tests.llm.test_near_copies import brute as brute_near_copies

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, range int, guest int, key string, value int, count int"


def corpus(seed=3):
    """Small texts with copies, near copies, shared passages, empties, NULLs and repeats."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ähre", "ÉTÉ", "x" * 30, "a.b,c", "<|endoftext|>", "don't", "中文", "½"]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = make(60)
    texts = ["", None, " \t\n", "one", "two words", None]
    for i in range(60):
        body = make(rnd.choice([3, 12, 13, 14, 40, 200]))
        if i % 4 == 0:
            at = rnd.randrange(len(body))
            body = body[:at] + passage[rnd.randrange(30):] + body[at:]
        texts.append(rnd.choice([" ", "\n", "  "]).join(body))
    texts += [texts[10], texts[10], texts[20] + " tail", texts[20].replace("w1", "w2", 1), "long " * 30_000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 1, 1, 1, "k", 1, 1) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nameless(spark):
    """NULL and repeated doc_ids, repeated rows."""
    text = " ".join(f"w{i}" for i in range(20))
    return spark.createDataFrame([(d, t, None, None, None, 0, 0, 0, None, 0, 0) for d, t in
                                  [(None, text), (None, None), (5, text), (5, text), (5, "other"), (1, text)]], SCHEMA)


def tokenizer(name):
    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    rnd = random.Random(1)
    letters = list("aAbB éÈßΣσς'stllve  \n\t\x1c\x85  　<|>123½Ⅷ中文한éİıﬁ.,!?🙂\x00")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += ["<|endoftext|> a<|startoftext|>b <|endoftext|>", " a  b", "", "a\n \nb", "x" * 3000, *[t or "" for _, t in corpus()]]
    library, own = Tokenizer.from_file(tokenizer(name)), bpe.Encoder(tokenizer(name))
    for text, got in zip(texts, own.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    texts = [t or "" for _, t in corpus()]
    small = bpe.Encoder(tokenizer("byte_bpe_50k.json"))
    first = small.encode(texts[:30]) + small.encode(texts[30:])
    assert first == bpe.Encoder(tokenizer("byte_bpe_50k.json")).encode(texts) == small.encode(texts)


def test_bpe_digest(docs, rows, empty):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digest(docs, tokenizer("word_bpe_49k.json")).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encoding_digest(empty, tokenizer("word_bpe_49k.json")).count() == 0


def edit_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_fingerprints(docs, rows, empty, nameless):
    ordered = sorted(rows)
    got = {r.doc_id: r for r in fingerprint.edited_neighbours(docs).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(ordered):
        t, follower = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + follower[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint_text(t) and r.edited_fingerprint == fingerprint.fingerprint_text(edited)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint_text(follower))
        assert 0 <= r.near_edited <= 1 and (t != edited or r.near_edited == 1)
    assert fingerprint.edited_neighbours(empty).count() == 0
    assert fingerprint.edited_neighbours(nameless).count() == 6


def test_likeness_is_the_edit_distance():
    rnd = random.Random(2)
    text = " ".join(f"word{rnd.randrange(3000)}" for _ in range(2000))
    near = fingerprint.likeness(fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(text[:5000] + "changed" + text[5010:]))
    other = fingerprint.likeness(fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(" ".join(f"word{rnd.randrange(3000)}" for _ in range(2000))))
    assert near > 0.8 and other < 0.3
    a, b = "".join(rnd.choice("ABC") * 2 for _ in range(40)), "".join(rnd.choice("ABC") * 2 for _ in range(50))
    assert fingerprint._common(a, b) == edit_common([a[i:i + 2] for i in range(0, len(a), 2)], [b[i:i + 2] for i in range(0, len(b), 2)])
    assert fingerprint.likeness("0::", "0::") == 1 and fingerprint.likeness("0::", "0:AA:AA") == 0 and fingerprint.likeness(None, "0::") == 0


def test_signature_covers_whole_texts():
    for text in ("a" * 100_000, "ab" * 50_000, "a" * 99_999 + "b", "x", "short text"):
        level, one, two = fingerprint.fingerprint_text(text).split(":")
        assert len(one) <= 2 * 64 and len(two) <= 2 * 64 and one
    assert fingerprint.fingerprint_text("a" * 100_000) != fingerprint.fingerprint_text("a" * 99_999 + "b")


def brute_repeats(rows):
    first, words = {}, {d: WORDS.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i:i + 13]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("chars", [500, 4_000_000])
def test_repeats(docs, rows, chars):
    want = brute_repeats(rows)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, bucket_chars=chars).collect()}
    assert {d: (r.n_words, r.n_removed, r.text) for d, r in got.items()} == want
    assert sum(r[1] for r in want.values()) > 500
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())


def test_repeats_on_edges(empty, nameless):
    assert substrings.remove_repeats(empty).count() == 0
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(nameless).collect())
    assert got == [(0, 0, 0), (0, 20, 0), (1, 20, 0), (5, 1, 0), (5, 20, 20), (5, 20, 20)]


def brute_simhash(rows, most=4):
    value = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        value[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value, classes(value, most)


def classes(value, most):
    parent = {d: d for d in value}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(value)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (value[a] ^ value[b]).bit_count() <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash(docs, rows, empty, nameless):
    value, component = brute_simhash(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{value[d]:016x}", component[d]) for d in value}
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(nameless).collect())[2:] == [(1, 1), (5, 1), (5, 1), (5, 5)]


def test_near_links_have_the_right_components(spark, monkeypatch):
    """A dense ball and chains of fingerprints, in buckets that must be split."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    rnd = random.Random(7)
    values = {rnd.getrandbits(64) for _ in range(200)}
    centre = rnd.getrandbits(64)
    for _ in range(150):
        values.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))))
    chain = rnd.getrandbits(64)
    for _ in range(12):
        chain ^= sum(1 << b for b in rnd.sample(range(64), 4))
        values.add(chain)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash._near_links(spark.createDataFrame([(v,) for v in signed], "value bigint"), 4)
    named = {r.node: r.component for r in simhash.components(links).collect()}
    want = classes({v: v % (1 << 64) for v in signed}, 4)
    assert {v: named.get(v, v) for v in signed} == want
    assert links.count() < 15 * len(values)


def test_codes_are_directly_addressable():
    rnd = np.random.default_rng(1)
    for ids in (rnd.integers(0, 50_000, 5000), rnd.integers(0, 200, 700), rnd.integers(0, 1 << 32, 999), np.zeros(0, int), np.full(1025, 256)):
        block = token_store.Codes(token_store.encode_codes(ids))
        assert block.length == len(ids)
        assert all(block.get(i) == ids[i] for i in range(0, len(ids), 37))
        for a in range(0, len(ids) + 1, 97):
            assert block.slice(a, min(len(ids), a + 150)).tolist() == ids[a:a + 150].tolist()
    with pytest.raises(IndexError):
        block.get(5000)


def test_token_files(spark, docs, rows, empty, nameless, tmp_path):
    library, path = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), str(tmp_path / "tokens")
    token_store.write_tokens(docs, tokenizer("word_bpe_49k.json"), path, segment_tokens=300)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(spark, path).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    first = spark.read.parquet(path).orderBy("range", "segment").first()
    assert token_store.token_at(spark, path, first.range, first.segment, 0) == (library.encode(sorted(rows)[0][1] or "", add_special_tokens=False).ids + [2])[0]
    assert token_store.store_and_read(empty, tokenizer("word_bpe_49k.json")).count() == 0
    assert [r.doc_id for r in token_store.store_and_read(nameless, tokenizer("word_bpe_49k.json")).orderBy("start").collect()] == [None, None, 1, 5, 5, 5]


def held_sequences(got, most):
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_packing(docs, rows, empty, nameless):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    got = packing.pack(docs, tokenizer("byte_bpe_50k.json"), max_tokens=64).collect()
    seen = defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.piece, r.start, r.length))
    for d, parts in seen.items():
        assert len(parts) == -(-len(ids[d]) // 64) and sum(n for *_, n in parts) == len(ids[d])
        assert all(n == 64 for _, _, n in sorted(parts)[1:])
    assert set(seen) == set(ids)
    assert held_sequences(got, 64) <= 1.02 * sum(map(len, ids.values())) / 64 + 1
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    assert held_sequences(packing.pack(nameless, tokenizer("byte_bpe_50k.json"), 16).collect(), 16)


def test_plans_use_the_histogram_up():
    rnd = random.Random(4)
    for size, histogram in ((64, {v: rnd.randrange(300) for v in range(1, 65)}), (10, {7: 5}), (8, {8: 3, 1: 1}), (5, {})):
        plan, used = packing.fit_plan(dict(histogram), size), defaultdict(int)
        for lengths, times in plan:
            assert sum(lengths) <= size and times > 0
            for v in lengths:
                used[v] += times
        assert dict(used) == {k: v for k, v in histogram.items() if v}
        left = np.array([histogram.get(v, 0) for v in range(size + 1)])
        assert sum(t for _, t in plan) <= 1.01 * sum(t for _, t in packing.best_fit(left, size)) + 1
    full = {40: 900, 24: 500, 14: 400, 10: 400, 64: 7}        # fits without waste
    assert sum(t for _, t in packing.fit_plan(full, 64)) == 907


def toxic_corpus(spark):
    rnd = random.Random(5)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rnd.choice(words) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            text[3], text[9] = rnd.choice(["grubel", "snarkish", "vileword"]), "gnarf" + rnd.choice("abcdefgh")
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if toxic else 0))
    return spark.createDataFrame(rows + [(None, "gnarfx grubel"), (5000, None), (5001, "")], "doc_id bigint, text string"), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id bigint, toxic int"), dict(labels)


def test_toxicity_finds_held_out_cases(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in truth:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = toxic_corpus(spark)
    flipped = labels.selectExpr("doc_id", f"case when {toxicity.HELD_OUT} then 1 - toxic else toxic end as toxic")
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_follows_from_the_text_alone(spark):
    """Twins of labelled texts under new doc_ids, with clashing columns and repeated rows, score alike."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    twins = docs.selectExpr("doc_id + 1000000 AS doc_id", "text").unionByName(docs.select("doc_id", "text")).selectExpr("*", "1 AS bin", "2 AS alone", "3 AS toxic", "4 AS score")
    twins = twins.unionByName(twins.where("doc_id < 20"))
    marks = labels.selectExpr("*", "'x' AS text", "0.5 AS score").unionByName(labels.selectExpr("*", "'x' AS text", "0.5 AS score").limit(50))
    seen = {}
    rows = toxicity.score(twins, marks).collect()
    assert len(rows) == twins.count()
    for r in rows:
        assert seen.setdefault(r.doc_id % 1_000_000, (r.score, r.predicted)) == (r.score, r.predicted)


def test_toxicity_without_labels(spark, empty):
    docs, labels, _ = toxic_corpus(spark)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.score(empty, labels).count() == 0


def test_block_max_neighbours_are_exact():
    rnd = np.random.default_rng(6)
    vectors = []
    for _ in range(700):
        terms = np.sort(rnd.choice(60, rnd.integers(1, 12), replace=False))
        w = rnd.random(len(terms))
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 60)
    for t, w in vectors[::20]:
        cosine = dense[:, t] @ w
        ids, scores = index.nearest(t, w, 15)
        assert np.allclose(np.sort(scores), np.sort(cosine)[-15:][np.sort(cosine)[-15:] > 0])
        assert np.allclose(cosine[ids], scores)


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows: nothing clean goes, copies and repeats do."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    one = corpus_pipeline.stored(kept["toxicity"](spark, docs, sf_dir), "t")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(texts) - toxic
    two = corpus_pipeline.stored(kept["simhash"](spark, one, sf_dir), "t")
    first = set(brute_near_copies([(d, t) for d, t in texts.items() if d not in toxic]).values())
    assert {r.doc_id for r in two.collect()} == first
    three = corpus_pipeline.stored(kept["substrings"](spark, two, sf_dir), "t")
    want = brute_repeats([(d, texts[d]) for d in first])
    assert three.columns == docs.columns
    for r in three.collect():
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else texts[r.doc_id]) and r.n_chars == len(r.text)
    assert held_sequences(kept["packing"](spark, three, sf_dir).collect(), 1024)


def test_pipeline_on_odd_tables(spark):
    """Empty tables, NULL and repeated doc_ids and clashing columns go through the stages after the first."""
    for rows in ([], [(None, "a b", 1), (None, None, 2), (4, "seven words are in this text twice", 3), (4, "seven words are in this text twice", 3), (5, "", 0), (6, None, 0)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").selectExpr("*", "'x' AS key", "1 AS node", "2 AS component", "X'00' AS body", "1 AS score")
        out = docs
        for name, stage in corpus_pipeline.STAGES[1:3]:
            out = corpus_pipeline.stored(stage(spark, out, ""), name)
            assert out.columns == docs.columns
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((d is not None, d or 0, t or "") for d, t, _ in rows if d != 6)
        assert sum(r.length for r in corpus_pipeline.STAGES[3][1](spark, out, "").collect()) >= out.count()
