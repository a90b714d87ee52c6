"""From documents to packed training sequences: five stages, each written as Parquet and reread by the next.

All but the last return rows of ``documents`` with their columns, whatever other columns there are. Of rows with equal
doc_id and text that a stage judges together, the judgement holds for all of them.

In every stage null text counts as empty, texts are read whole however long, null and repeated ids are rows like others,
and an empty table gives an empty result. What the stages make of such rows:

* quality classifier: an empty text is scored by its length alone; without labels of both kinds nothing is dropped.
* exact dedup: all empty and null texts are one group; of rows equal in id and text one stays.
* MinHash near-dedup: a text without words is a class of its own and stays; the lowest id of a class stays.
* benchmark decontamination: a text without words is clean; an empty benchmark drops nothing.
* best-fit packing: an empty text is one piece, the separator.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spendlens.llm import decontaminate, exactdedup, minhash, packing, quality  # noqa: E402
from spendlens.llm.common import Scratch, released, table, text_of  # noqa: E402


def _where(docs: DataFrame, judged: DataFrame, keep: bool) -> DataFrame:
    """The rows of ``docs`` that are (or aren't) among the judged (doc_id, tkey)."""
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct()
    on = docs["doc_id"].eqNullSafe(judged["_id"]) & (F.xxhash64(text_of()) == judged["_tkey"])
    return docs.join(judged, on, "left_semi" if keep else "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores below its threshold."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id."""
    return exactdedup.without_copies(spark, docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return _where(docs, minhash.near_duplicates(spark, docs).where("not kept"), keep=False)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return _where(docs, decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).where("contaminated"), keep=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage has read and written on its way goes when its result is stored."""
    scratch, given = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    docs = given
    for name, stage in STAGES:
        with released():
            kept = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if docs is not given:
            scratch.drop(docs)
        docs = kept
    return docs


#: Compression and signatures can't be expressed in SQL; tests/llm holds what each stage keeps against plain Python.
ORACLE_SQL = None
