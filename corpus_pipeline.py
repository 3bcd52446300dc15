"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import base
from quillon.llm.decontam import find_leaks
from quillon.llm.jaccard import BROADCAST_IDS, jaccard_classes
from quillon.llm.packing import pack_documents
from quillon.llm.quality import quality_scores
from quillon.llm.substring import cut_repeats

#: A row's number, for the decontamination stage alone.
ROW = "_row"


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs but for rows with one of the ids(key); these are broadcast if they are few."""
    ids = base.written(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality_scores(docs, base.table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return _without(docs, jaccard_classes(docs).where("doc_id <> component_id").select("doc_id"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of passages of 50 words go; a document of which nothing is left goes. Others
    keep their text as it is."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = cut_repeats(docs, carry=rest, layout=True).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": n_chars}
    return cut.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; whatever their doc_id, the very rows that hold it."""
    keyed = base.written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    leaks = find_leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), base.table(spark, sf_dir, "benchmark"))
    return _without(keyed, leaks.select(F.col("doc_id").alias(ROW)), ROW).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 token ids."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
