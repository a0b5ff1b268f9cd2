"""Operator 8: toxicity by nearest labelled examples.

Labelled texts are TF-IDF vectors over terms that tell the labels apart (whole words and word
beginnings, chosen on the labelled sample). A block-max inverted index holds, for each term,
its largest weight in every block of examples; a query visits blocks in order of their bound
and stops when no bound can beat its kth cosine, so the neighbours are exact. Votes weighted by
distance are calibrated on labelled rows, where a row of the sample does not vote for itself. A
score follows from the text alone: all rows, examples or not, are scored by all examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import plain_text, stored
from tablewright.session import hold

#: Labelled rows of each class that are examples; the rest of the labels calibrates.
EXAMPLES_PER_CLASS = 8_000
#: Terms that tell the labels apart: most of them, and the least evidence (a likelihood ratio) for one.
MOST_TERMS = 2_048
LEAST_EVIDENCE = 30.0
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.3
#: Word beginnings that are terms too.
PREFIXES = (4, 5, 6)
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"
_BINS = 64
_CACHE_ENTRIES = 200_000
_WORD = re.compile(r"\w+")


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def _term_counts(rows: DataFrame) -> DataFrame:
    """``(term, toxic, plain)``: documents of each class that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out():
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": [counts[1][t] for t in terms], "plain": [counts[0][t] for t in terms]})

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update({t for w in set(_WORD.findall(text.lower())) for t in word_terms(w)})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from out()
                    counts[0].clear()
                    counts[1].clear()
        yield from out()

    found = rows.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, plain bigint")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _evidence(toxic: int, plain: int) -> Column:
    """Likelihood ratio statistic of a term, from its counts and the classes' sizes."""
    a, c, total = F.col("toxic").cast("double"), F.col("plain").cast("double"), float(toxic + plain)

    def cell(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen * total / (row * column))).otherwise(0.0)

    return cell(a, a + c, toxic) + cell(c, a + c, plain) + cell(toxic - a, total - a - c, toxic) + cell(plain - c, total - a - c, plain)


def _sparse(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``(doc_id, terms, counts)`` of every row over a vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}

        def ids(piece: str) -> tuple:
            found = tuple(vocabulary[t] for w in _WORD.findall(piece) for t in word_terms(w) if t in vocabulary)
            if len(known) > _CACHE_ENTRIES:
                known.clear()
            known[piece] = found
            return found

        for batch in batches:
            terms, counts = [], []
            for text in batch.column(1).to_pylist():
                pieces = text.lower().split()
                bag: Counter = Counter()
                for piece, found in zip(pieces, list(map(known.get, pieces))):
                    if found is None:
                        found = ids(piece)
                    if found:
                        bag.update(found)
                order = sorted(bag)
                terms.append(order)
                counts.append([bag[t] for t in order])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms array<int>, counts array<int>")


def tf_idf(terms, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of term counts."""
    t = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, float))) * idf[t]
    return t, w / max(np.sqrt((w * w).sum()), 1e-300)


class BlockMaxIndex:
    """Examples in blocks of similar ones, with each term's largest weight in every block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        lead = [(int(t[np.argmax(w)]), -float(w.max()), i) for i, (t, w) in enumerate(vectors)]
        self.order = np.array([i for *_, i in sorted(lead)], np.int64)
        n_blocks = -(-len(vectors) // BLOCK)
        self.most = np.zeros((n_terms, n_blocks))
        self.local = np.full((n_blocks, n_terms), -1, np.int16)
        self.weights: list[np.ndarray] = []
        for b in range(n_blocks):
            rows = [vectors[i] for i in self.order[b * BLOCK:(b + 1) * BLOCK]]
            terms = np.unique(np.concatenate([t for t, _ in rows]))
            self.local[b, terms] = np.arange(len(terms))
            dense = np.zeros((len(rows), len(terms)))
            for r, (t, w) in enumerate(rows):
                dense[r, self.local[b, t]] = w
            self.most[terms, b] = dense.max(0)
            self.weights.append(dense)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k highest cosines above zero, ties to the earlier example."""
        bound = weights @ self.most[terms]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(ids) == k and bound[b] < scores[-1] - 1e-12):
                break
            at = self.local[b, terms]
            held = at >= 0
            score = self.weights[b][:, at[held]] @ weights[held]
            start = b * BLOCK
            ids = np.concatenate((ids, self.order[start:start + len(score)]))
            scores = np.concatenate((scores, score))
            keep = np.lexsort((ids, -scores))[:k]
            keep = keep[scores[keep] > 0]
            ids, scores = ids[keep], scores[keep]
        return ids, scores


def _calibration(bins: list[tuple[int, float, float]]) -> dict[int, float]:
    """Toxic share of each vote bin, smoothed and made non-decreasing by pooling neighbours."""
    blocks: list[list] = []
    total, toxic = sum(n for _, n, _ in bins), sum(t for *_, t in bins)
    prior = toxic / total if total else 0.0
    for b, n, t in sorted(bins):
        blocks.append([t + prior, n + 1.0, [b]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, more = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][2] += more
    return {b: t / n for t, n, bs in blocks for b in bs}


def _bin(pull: np.ndarray) -> int:
    """The bin of the toxic share of votes (plain, toxic); -1 without votes."""
    total = pull.sum()
    return int(min(_BINS - 1, _BINS * pull[:, 1].sum() / total)) if total > 1e-12 else -1


def score(docs: DataFrame, labels: DataFrame, examples_per_class: int = EXAMPLES_PER_CLASS, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for every row of ``docs``.

    Labels of rows that ``HELD_OUT`` selects are never read. Examples are a sample of at most
    ``examples_per_class`` labelled rows of each class, in crc32 order of doc_id; document
    frequencies come from all rows. score is the calibrated probability of label 1; a text
    without any known term, an empty or a NULL text get the rate of such labelled texts.
    evidence holds the nearest examples (doc_id, cosine, toxic share). Without usable labels
    every score is 0, with one class only it is that class's. NULL labels are skipped, of
    repeated labels the highest counts; repeated rows are scored each; a NULL doc_id is scored
    and never labelled; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text("text").alias("text"))
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = hold(usable.where(f"NOT ({HELD_OUT})"))
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(examples_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stored(chosen, "examples")
    sample = stored(source.join(F.broadcast(chosen), "doc_id"), "labelled")        # at most twice examples_per_class rows
    taken = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all_toxic, all_plain = taken.get(1, 0), taken.get(0, 0)
    vocabulary: dict[str, int] = {}
    if all_toxic and all_plain:
        candidates = _term_counts(sample).where("toxic >= 3").where(F.col("toxic") * all_plain > 2 * F.col("plain") * all_toxic)
        best = candidates.withColumn("evidence", _evidence(all_toxic, all_plain)).where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "term").limit(MOST_TERMS).collect()
        vocabulary = {r.term: i for i, r in enumerate(best)}

    bags = stored(_sparse(source, vocabulary), "bags")
    frequency = {r.term: r["count"] for r in bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    count = bags.count()
    idf = np.array([math.log((1 + count) / (1 + frequency.get(t, 0))) + 1 for t in range(len(vocabulary))])
    weight = {label: sizes.get(label, 0) / taken[label] for label in taken}
    merged: dict[tuple, list] = {}
    for r in bags.where(F.size("terms") > 0).join(F.broadcast(chosen), "doc_id").select("doc_id", "terms", "counts", "toxic").collect():
        entry = merged.setdefault((tuple(r.terms), tuple(r.counts)), [0.0, 0.0, r.doc_id])
        entry[r.toxic] += weight[r.toxic]
        entry[2] = min(entry[2], r.doc_id)
    ordered = sorted(merged.items())
    index = BlockMaxIndex([tf_idf(*v, idf) for v, _ in ordered], len(vocabulary)) if ordered else None
    shared = spark.sparkContext.broadcast((index, idf, np.array([v[:2] for _, v in ordered]).reshape(-1, 2), [v[2] for _, v in ordered],
                                           {v: i for i, (v, _) in enumerate(ordered)}, weight))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf, mass, names, number, weight = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
        for batch in batches:
            bins, alone, evidence = [], [], []
            for terms, counts, label in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                ids = np.zeros(0, np.int64)
                if terms and index is not None:
                    ids, cosine = index.nearest(*tf_idf(terms, counts, idf), neighbours)
                if not len(ids):
                    bins.append(-1)
                    alone.append(-1)
                    evidence.append([])
                    continue
                near = (cosine / (1.05 - np.minimum(cosine, 1)))[:, None]
                bins.append(_bin(mass[ids] * near))
                own = mass[ids].copy()
                if label is not None:                                    # one of the examples, for calibration: its own vote goes
                    own[ids == number[(tuple(terms), tuple(counts))], label] -= weight[label]
                alone.append(_bin(np.maximum(own, 0) * near))
                evidence.append([{"doc_id": names[i], "cosine": float(c), "toxic_share": float(m[1] / max(m.sum(), 1e-12))} for i, c, m in zip(ids[:3].tolist(), cosine, mass[ids[:3]])])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bin": pa.array(bins, pa.int32()), "alone": pa.array(alone, pa.int32()), "evidence": pa.array(evidence, kind)})

    marked = bags.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "terms", "counts", "toxic")
    voted = stored(marked.mapInArrow(votes, "doc_id bigint, bin int, alone int, evidence array<struct<doc_id:bigint,cosine:double,toxic_share:double>>"), "votes")
    told = voted.join(usable, "doc_id").groupBy(F.col("alone").alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()
    apart = [(r.bin, r.n, r.t) for r in told if r.bin < 0]
    rates = _calibration([(r.bin, r.n, r.t) for r in told if r.bin >= 0])
    usable.unpersist()
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.0
    rates[-1] = (apart[0][2] + prior) / (apart[0][1] + 1) if apart else prior
    seen = sorted(b for b in rates if b >= 0)
    for b in range(_BINS):                                               # bins without labelled rows take the nearest's
        rates.setdefault(b, rates[min(seen, key=lambda s: (abs(s - b), s))] if seen else prior)
    table = F.create_map(*(F.lit(v) for pair in sorted(rates.items()) for v in pair))
    value = table[F.col("bin")].cast("double")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    return voted.select("doc_id", held.alias("held_out"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"), "evidence")
