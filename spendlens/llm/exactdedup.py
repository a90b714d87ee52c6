"""Exact duplicates by content sort (operator 9).

Rows are range-partitioned by the leading characters of the normalised text, then a hash of it, then the id: Spark
samples the splitters, so a large group of copies spreads over as many ranges as it needs. Inside a range the sort
(external: it spills) puts equal texts next to each other, and each text is compared in full with its neighbour.
What a range's first run continues from the range before is settled from the runs' digests, one row per run.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays (null ids come last; of rows that are equal in both, the first in order). Other columns are passed on
unread where a stage asks for them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import Scratch, ascii_lower, sha_of, small, table, text_of

LEAD = 48  # leading characters in the splitters
RUN = "text_sha256 string, part int, run long, leads boolean"


def _runs(batches: Iterator[pa.RecordBatch], passed: int) -> Iterator[pa.RecordBatch]:
    """The first ``passed`` columns, and for each row the number of its run of equal texts in this range."""
    part, run, before = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        if not len(batch):
            continue
        text = batch.column(passed)
        new = np.ones(len(batch), bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = before is None or before != text[0].as_py()
        runs = run + np.cumsum(new)
        run, before = int(runs[-1]), text[-1].as_py()
        own = [batch.column(passed + 1), pa.array(np.full(len(batch), part, np.int32)), pa.array(runs), pa.array(new)]
        names = [f"c{i}" for i in range(passed)] + ["text_sha256", "part", "run", "leads"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *own], names)


def content_runs(scratch: Scratch, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` (as c0, c1, ...), text_sha256, part, run, leads: each row's run of equal texts in its range."""
    norm = ascii_lower(text_of())
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id").alias("_id"), norm.alias("_norm"))
    rows = rows.withColumns({"_sha": sha_of(F.col("_norm")), "_lead": F.substring("_norm", 1, LEAD), "_hash": F.xxhash64("_norm")})
    last = F.col("_id").desc_nulls_last()
    rows = rows.repartitionByRange("_lead", "_hash", last).sortWithinPartitions("_lead", "_hash", "_norm", last)
    kept = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([rows.schema[c] for c in kept] + T._parse_datatype_string(RUN).fields)
    return scratch.save(rows.select(*kept, "_norm", "_sha").mapInArrow(partial(_runs, passed=len(columns)), schema), "runs")


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    rows = content_runs(Scratch(spark, "exact"), docs, ["doc_id"]).withColumnRenamed("c0", "doc_id")
    runs = rows.groupBy("part", "run", "text_sha256").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size"))
    groups = runs.groupBy("text_sha256").agg(F.max("top").alias("keep_id"), F.sum("size").alias("group_size"), F.min("part").alias("first"))
    runs = runs.select("part", "run", "text_sha256").join(groups, "text_sha256").drop("text_sha256")
    out = rows.join(runs, ["part", "run"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("leads") & (F.col("part") == F.col("first"))).alias("kept"), "text_sha256")


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; the text is moved once."""
    rows = content_runs(Scratch(spark, "exact"), docs, docs.columns)
    # Of a group that spans ranges, the first run of each later range leads there without leading the group.
    edge = rows.where("run = 0 and leads").select("part", "text_sha256")
    first = rows.where("leads").groupBy("text_sha256").agg(F.min("part").alias("first")).join(edge, "text_sha256").where("first < part")
    later = first.select("part", F.lit(0).cast("long").alias("run"))  # at most one row per range
    kept = rows.where("leads").join(small(later), ["part", "run"], "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
s AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256)
"""
