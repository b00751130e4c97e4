"""Corpus pipeline: stages over `documents`, each written as Parquet and read again for the next.

Every stage works on all that the one before kept; all but the last return the columns of documents. Rows without doc_id
pass the filters as they are. Rows that repeat a doc_id repeat its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import jaccard_join, line_dedup, packing, substring_dedup, toxicity
from inkveil.llm import queries as numbered
from inkveil.llm._shared import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame, max_broadcast: int = 1 << 20) -> DataFrame:
    """docs less those in `gone` (doc_id). Up to max_broadcast ids go to the scan; beyond, both sides are shuffled."""
    gone = stash(gone.select("doc_id").distinct(), "gone")
    few = gone.limit(max_broadcast + 1).count() <= max_broadcast
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def _rewritten(docs: DataFrame, changed: DataFrame, max_broadcast: int = 1 << 20) -> DataFrame:
    """docs with the texts of `changed` (doc_id, text) for its documents; the others are read as they are."""
    changed = stash(changed, "changed").dropDuplicates(["doc_id"])
    few = changed.limit(max_broadcast + 1).count() <= max_broadcast
    ids = changed.select("doc_id")
    ids = F.broadcast(ids) if few else ids
    others = docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)
    meta = docs.select("doc_id", "lang", "source").join(ids, "doc_id", "left_semi")
    return others.unionByName(meta.join(changed, "doc_id").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    judged = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.where("predicted = 1 AND doc_id IS NOT NULL"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points found in 5 documents or more stay in the one with the largest doc_id only."""
    kept = line_dedup.dedup_lines(docs).where("n_dropped > 0 AND doc_id IS NOT NULL")
    return _rewritten(docs, kept.select("doc_id", F.col("kept_text").alias("text")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    groups = jaccard_join.near_duplicates(docs)
    return _without(docs, groups.where("component_id <> doc_id"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier go."""
    kept = substring_dedup.remove_repeats(docs).where("n_removed > 0 AND doc_id IS NOT NULL")
    return _rewritten(docs, kept.select("doc_id", F.col("kept_text").alias("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, numbered.WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", keep_one_of_near_copies),
    ("substring dedup", drop_repeated_spans),
    ("best-fit packing", pack),
]

#: Language models and tokenizers are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
