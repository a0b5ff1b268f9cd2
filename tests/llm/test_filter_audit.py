"""Filter audit against removal one filter at a time, document by document."""

import random
from collections import Counter
from itertools import permutations

import numpy as np

from tablewright.llm import filter_audit


def fails(rows):
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    out = []
    for d, _, t in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if d is not None and d > least[t]:
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    bad = fails(rows)
    want, shapley = {}, Counter()
    for part in {p or "" for _, p, _ in rows}:
        mine = [(d, b) for (d, p, _), b in zip(rows, bad) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(d, b) for d, b in left if f in b]
                redundant = sum(f in b for _, b in mine) - len(gone)
                left = [(d, b) for d, b in left if f not in b]
                shapley[part, f] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), redundant, sum(b == {f} for _, b in mine),
                                                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_all_orders(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows = [(None, "en", "a b"), (None, None, None), (7, None, ""), (7, "", ""), (1, "en", "É" * 9000), (2, "x\ny", "Q | \x0b q\x1cq")]
    for i in range(10, 90):
        text = " ".join(rnd.choices(words[: rnd.choice([40, 900])], k=rnd.choice([3, 199, 200, 400])))
        text = rnd.choice([str.upper, str, str.capitalize])(text) + rnd.choice(["", " $", " *"])
        rows.append((i, rnd.choice(["en", "de", None, "de"]), text))
        if rnd.random() < 0.5:
            rows.append((rnd.choice([i, i + 500, i - 100]), rnd.choice(["en", "fr"]), text))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(95) if i % 3] + [(12, 0, 1), (12, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, lang string, text string, mask int").repartition(5)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute(rows, [r for r in labels if r[0] is not None])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, lang string, text string")
    got = filter_audit.audit(one, marks).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.part for r in got} == {""}


def test_steps_are_minima():
    orders, position, step = filter_audit.removal_steps()
    for o in (0, 17, 119):
        for mask in range(32):
            hit = [s for s, f in enumerate(orders[o]) if mask >> f & 1]
            assert step[o, mask] == (hit[0] if hit else 5)
    assert np.array_equal(np.take_along_axis(orders, position, 1), np.tile(np.arange(5), (120, 1)))
