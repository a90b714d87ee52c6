"""Incremental upload: transaction CSV files arriving in a folder -> the stored table.

The reference loads uploaded CSV files into its table (clean, then append).
Here the upload folder is a Structured Streaming file source: each
micro-batch is cleaned with the same column expressions as the batch path and
written under ``<table>/stream/batch_id=<n>`` with overwrite, so a batch that
is replayed after a failure replaces its own output (exactly-once into the
table, given the checkpoint). ``trigger(availableNow=True)`` processes what is
there and stops; a continuous job uses a processing-time trigger instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendlens.operators.clean import normalize
from spendlens.sources.table import CSV_OPTIONS, na_to_null, spans_lines


def _text_schema(spark: SparkSession, source_dir: str) -> T.StructType:
    """Header names of the upload folder's files, every column as text."""
    names = spark.read.options(**CSV_OPTIONS).option("inferSchema", False).csv(source_dir).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def cleaned_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 2, multi_line: bool | None = None) -> DataFrame:
    """``multi_line``: whether files may hold records that span lines; by default as the files that are there do."""
    multi_line = spans_lines(spark, source_dir) if multi_line is None else multi_line
    raw = (
        spark.readStream.options(**CSV_OPTIONS)
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .schema(_text_schema(spark, source_dir))
        .csv(source_dir)
    )
    return normalize(na_to_null(raw))


def ingest(spark: SparkSession, source_dir: str, table_root: str, available_now: bool = True) -> StreamingQuery:
    out_dir = f"{table_root}/stream"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.sortWithinPartitions("date").write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    # A job that goes on will meet files that nobody has looked at.
    stream = cleaned_stream(spark, source_dir, multi_line=None if available_now else True)
    writer = stream.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", f"{table_root}/_checkpoint"
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_ingested(spark: SparkSession, table_root: str) -> DataFrame:
    from spendlens.schema import TRANSACTIONS

    schema = T.StructType(TRANSACTIONS.fields + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{table_root}/stream").drop("batch_id")
