"""Near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more.

No limit on SimHash bits finds all of them (at 0.8 about ten of 64 bits differ, sixteen and more
now and then), so SimHash links only put sets into a candidate group; MinHash buckets put in the
rest. Whole shingle sets decide within each group, whose texts meet once: no text travels with
a pair, and no pairs are written but the links of a forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import minhash, simhash
from tablewright.llm.minhash import Similarity

LIKE = Similarity(words=5, share=4, of_all=5, rows=4)


def simhash_links(sets: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of sets whose fingerprints differ in at most four bits (a forest of them)."""
    owners = sets.groupBy("value").agg(F.min("node").alias("owner"))
    same = sets.join(owners, "value").where("node <> owner").select(F.col("owner").alias("a"), F.col("node").alias("b"))
    links = simhash._near_links(owners.select("value"), simhash.MOST_BITS)
    named = owners.withColumnRenamed("owner", "node")
    one = named.select(F.col("value").alias("a"), F.col("node").alias("one"))
    two = named.select(F.col("value").alias("b"), F.col("node").alias("two"))
    return same.unionByName(links.join(one, "a").join(two, "b").select(F.col("one").alias("a"), F.col("two").alias("b")))


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` for every row; component_id is the smallest doc_id that links reach.

    Texts with a similarity of 0.8 or more are linked; a text of under five words is one shingle,
    and texts without words are copies of each other. Rows of one doc_id are one document; rows of
    NULL doc_id take part but never name a component (NULL for one of only such rows); repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    found = minhash.near_duplicates(docs, LIKE, proposed=simhash_links, mark=simhash.fingerprint_of, empty_linked=True)
    return found.select("doc_id", "component_id")
