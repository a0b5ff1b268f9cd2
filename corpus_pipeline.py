"""Training-data pipeline: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet in the shared folder and read again. All but the last return the columns
that came in. Rows of NULL doc_id are never rejected; rows of one doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import near_copies, packing, substrings, toxicity
from tablewright.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.join(scored.where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of those linked by five-word shingle similarity of 0.8 or more."""
    copies = near_copies.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that an earlier one has; its text is left as it is if none goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substrings.remove_repeats(docs, rest=rest, whole=True)
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col("rest")[c] for c in rest}}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast("bigint")
    return out.select(*(values[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("packing", pack),
]

#: SQL cannot learn, link or tokenise; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
