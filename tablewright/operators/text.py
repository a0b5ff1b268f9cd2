"""Bag-of-words features: tokens, n-grams, vocabulary, counts, TF-IDF and hashing.

Results are long, ``(key, term, value)``: a wide table of hundreds of term columns is
only built on request and always from a vocabulary of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_slot
from tablewright.operators.schema import string_columns
from tablewright.session import spread
from tablewright.sources.stored_plans import storable

# Fixed value: words are runs of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Parts of the literal idf table; a term is looked up in one of them.
_SLOTS = 64


def tokens(text: Column) -> Column:
    """Lower-case words of a text; a missing text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(words: Column, smallest: int = 1, largest: int = 2) -> Column:
    """All word n-grams of the given lengths, joined by one space."""
    def at_least(n: int) -> Column:
        return F.greatest(F.size(words) - n, F.lit(0))

    parts, run = [], words
    for n in range(1, largest + 1):
        if n > 1:
            # Pair every run of n-1 words with the word that follows it.
            following = F.slice(words, n, at_least(n - 1))
            before = F.slice(run, 1, at_least(n - 1))
            run = F.zip_with(before, following, lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= smallest:
            parts.append(run)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def with_tokens(df: DataFrame, column: str) -> DataFrame:
    return df.select("*", tokens(F.col(column)).alias("tokens"))


def _grams(df: DataFrame, column: str, spans: tuple[int, int]) -> DataFrame:
    # The words are extracted once in their own projection, then combined.
    worded = spread(df).withColumn("_words", tokens(F.col(column)))
    return worded.withColumn("_grams", ngrams(F.col("_words"), *spans)).drop("_words")


def _tally(df: DataFrame, key: list[str], values: Column) -> DataFrame:
    """``key`` and ``_tally``: each distinct value of a row's array with its count, in order.

    Works inside the row: sorted values, then the ends of their runs. Every step is a
    projection of its own, so that no array is computed again for each of its elements.
    """
    ordered = df.select(*key, F.array_sort(values).alias("_sorted"))
    last = F.size("_sorted") - 1
    places = F.transform("_sorted", lambda v, i: F.struct(v.alias("value"), i.alias("at")))
    ends = ordered.select(*key, F.filter(
        places, lambda e: (e["at"] == last) | (F.get("_sorted", e["at"] + 1) != e["value"])).alias("_ends"))
    return ends.select(*key, F.transform("_ends", lambda e, i: F.struct(
        e["value"].alias("value"),
        (e["at"] - F.coalesce(F.get("_ends", i - 1)["at"], F.lit(-1))).cast("bigint").alias("n"))).alias("_tally"))


def _in_rows(df: DataFrame, columns: list[str], array: str) -> DataFrame:
    # The outer form: the plain one makes the optimiser evaluate the array once more as a filter.
    return df.select(*columns, F.inline_outer(array)).where("value IS NOT NULL")


def vocabulary(df: DataFrame, column: str, spans: tuple[int, int] = (1, 2), min_df: int = 2,
               max_features: int | None = 500) -> DataFrame:
    """(term, n, df, position): frequent terms, positions in alphabetical order.

    A document sends each of its terms once, with the count; one shuffle with map-side
    combine adds counts and documents.
    """
    per_document = _tally(_grams(df.select(column), column, spans), [], F.col("_grams"))
    terms = (
        _in_rows(per_document, [], "_tally").groupBy(F.col("value").alias("term"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    )
    if max_features is None:
        return terms.select("term", "n", "df", F.lit(None).cast("int").alias("position"))
    best = terms.orderBy(F.desc("n"), "term").limit(max_features)
    # At most max_features rows: one task may number them.
    return best.withColumn("position", F.row_number().over(Window.orderBy("term")) - 1)


@storable
@dataclass(frozen=True)
class FittedText:
    """A bounded vocabulary with the number of documents it was learnt from."""

    column: str
    spans: tuple[int, int]
    terms: tuple[tuple[str, int], ...]
    n_documents: int

    def _tally(self, df: DataFrame, key: str) -> DataFrame:
        """(key, _tally): vocabulary terms of each row with their counts."""
        known = [t for t, _ in self.terms]
        grams = _grams(df.select(key, self.column), self.column, self.spans)
        kept = F.filter("_grams", lambda g: g.isin(known)) if known else F.array().cast("array<string>")
        return _tally(grams, [key], kept)

    def _idf(self, term: Column) -> Column:
        """Smoothed idf of a vocabulary term, from a literal table in ``_SLOTS`` parts."""
        parts: list[list[Column]] = [[F.lit(""), F.lit(0.0)] for _ in range(_SLOTS)]
        for t, df in self.terms:
            parts[crc32(t.encode()) % _SLOTS] += [F.lit(t), F.lit(math.log((1.0 + self.n_documents) / (1.0 + df)) + 1.0)]
        tables = F.array(*[F.create_map(*p) for p in parts])
        return F.get(tables, (F.crc32(term) % _SLOTS).cast("int"))[term]

    def counts(self, df: DataFrame, key: str) -> DataFrame:
        """(key, term, value): occurrences of each vocabulary term.

        One row is one document, counted where it is read: no shuffle.
        """
        return _in_rows(self._tally(df, key), [key], "_tally").select(
            key, F.col("value").alias("term"), F.col("n").alias("value"))

    def tfidf(self, df: DataFrame, key: str) -> DataFrame:
        """(key, term, value): smoothed idf, rows scaled to length one, without a shuffle."""
        weighted = self._tally(df, key).select(key, F.transform("_tally", lambda c: F.struct(
            c["value"].alias("value"), (c["n"] * self._idf(c["value"])).alias("weight"))).alias("_weights"))
        return _scaled(weighted, key).select(key, F.col("value").alias("term"), F.col("scaled").alias("value"))

    def wide(self, long: DataFrame, key: str) -> DataFrame:
        """One column ``{column}__{term}`` per vocabulary term, 0 where absent."""
        names = [t for t, _ in self.terms]
        return long.groupBy(key).agg(*[
            F.coalesce(F.max(F.when(F.col("term") == t, F.col("value"))), F.lit(0)).alias(f"{self.column}__{t}")
            for t in names])


def _scaled(weighted: DataFrame, key: str) -> DataFrame:
    """One row per weight, ``scaled`` to length one over the row's ``_weights``."""
    length = F.sqrt(F.aggregate("_weights", F.lit(0.0), lambda total, c: total + c["weight"] * c["weight"]))
    return _in_rows(weighted.withColumn("_length", length), [key, "_length"], "_weights").withColumn(
        "scaled", F.col("weight") / F.col("_length"))


def fit_text(df: DataFrame, column: str, spans: tuple[int, int] = (1, 2), min_df: int = 2,
             max_features: int = 500) -> FittedText:
    terms = vocabulary(df, column, spans, min_df, max_features).orderBy("position").collect()
    return FittedText(column, spans, tuple((r["term"], r["df"]) for r in terms), df.count())


def hashing_counts(df: DataFrame, key: str, column: str, slots: int = 500,
                   spans: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, slot, n, value): stateless term slots; value is n scaled to row length one."""
    grams = _grams(df.select(key, column), column, spans)
    tally = _tally(grams, [key], F.transform("_grams", lambda g: hash_slot(g, slots)))
    weighted = tally.select(key, F.transform("_tally", lambda c: F.struct(
        c["value"].alias("value"), c["n"].alias("n"), c["n"].cast("double").alias("weight"))).alias("_weights"))
    return _scaled(weighted, key).select(key, F.col("value").alias("slot"), "n", F.col("scaled").alias("value"))


def detect_text_columns(df: DataFrame, threshold: float = 20.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(column, mean_length, is_text): text columns with long values."""
    columns = [c for c in string_columns(df) if c not in exclude]
    cells = [F.struct(F.lit(c).alias("column"), F.avg(F.length(c).cast("double")).alias("mean_length")) for c in columns]
    return (
        df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        .withColumn("is_text", F.coalesce(F.col("mean_length") > threshold, F.lit(False)))
    )
