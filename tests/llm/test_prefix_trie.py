"""The prefix trie against sets of prefixes built conversation by conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from tablewright.llm import prefix_trie


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    seq = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = {}
    children, below = defaultdict(set), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].add(node)
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    for node, held in members.items():
        ends = sorted(c for c in held if len(seq[c]) == len(node))
        out[min(held), len(node)] = (
            min(members[node[:-1]]) if node else None, len(held), len(children[node]), sum(not children[v] for v in below[node]),
            sum((len(members[v]) - 1) * (words(v[-1][1]) if v else 0) for v in below[node]),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    assert len(out) == len(members)
    return out


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn int, role string, text string, depth int").repartition(parts)
    got = prefix_trie.trie(df).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def made(rnd, n, copies, longest):
    rows = []
    plain = [(t, rnd.choice(["user", "assistant"]), f"turn {t} of all") for t in range(4)]
    for c in range(n):
        if c % 9 == 4:
            continue
        if rnd.random() < copies:
            rows += [(c, *t) for t in plain]
            continue
        for t in range(rnd.choice([1, 2, 3, 5, longest if c % 20 == 0 else 4])):
            rows.append((c, rnd.choice([t, t, None]) if t else 0, rnd.choice(["user", "assistant", None]), rnd.choice([f"a  b\t{rnd.randrange(3)}", "", None, "x\x0by z"])))
    return rows


def test_against_prefix_sets(spark):
    rnd = random.Random(4)
    rows = made(rnd, 160, 0.3, 150) + [(None, 1, "user", "lost"), (7, 0, "user", "again"), (7, 0, "user", "again"), (-3, 0, "user", "minus")]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark, rows) == brute(rows)


def test_a_turnless_conversation_and_an_empty_table(spark):
    alone = [c for c in range(21, 39) if zlib.crc32(str(c).encode()) % 4 >= 1][0]
    rows = [(alone, 0, "user", "gone with its head")]
    assert found(spark, rows) == brute(rows) == {(alone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}
    assert found(spark, []) == {}


def test_shards_meet(spark):
    """Many shards of few rows give the nodes of one shard."""
    rnd = random.Random(8)
    rows = made(rnd, 120, 0.2, 70)
    held, prefix_trie.SHARD_ROWS = prefix_trie.SHARD_ROWS, 7
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        prefix_trie.SHARD_ROWS = held


def test_order_over_several_matrices():
    rnd = random.Random(3)
    rows = [tuple(rnd.choice([1, 2]) for _ in range(k)) for k in (0, 64, 64, 65, 128, 129, 200, 3)]
    rows += [r[:64] for r in rows if len(r) > 64] + [r[:128] for r in rows if len(r) > 128] + [rows[6] + (1,), rows[6] + (2,)]
    rows = list(set(rows))
    flat = np.array([x for r in rows for x in r], np.uint64)
    length = np.array([len(r) for r in rows])
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    order = prefix_trie._sorted(flat, start, length)
    assert [rows[i] for i in order] == sorted(rows)
    shared = prefix_trie._shared(flat, start[order], length[order])
    want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(sorted(rows), sorted(rows)[1:])]
    assert shared.tolist() == want
