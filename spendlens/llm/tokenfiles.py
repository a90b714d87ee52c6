"""Token-id files: one zstandard frame per document, compressed with a shared dictionary (operator 3).

A file is a Parquet part of shards. A shard holds the frames of consecutive documents, one after the other, and beside
them the offset index (doc_ids, offsets, n_tokens), the ids that come before it in its part, and the hash of the
dictionary. One short document is read by its shard's range of ids (pushed down), its offset and one small frame. Parts
are ranges of doc_id in ascending order; Spark's commit protocol replaces the files of lost or repeated tasks.

The dictionary is trained on the ids of SAMPLE documents (those with the lowest hash of doc_id, LEAD ids of each); that
is its only bound, every document is written whole. Null text counts as empty and has the end id only; null ids come
first; rows with equal ids follow each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, one_text, table, text_of
from spendlens.llm.tokens import encoder

END_ID = 2
SAMPLE, LEAD, DICTIONARY_BYTES = 2000, 2048, 65536
SHARD_BYTES, LEVEL = 1 << 20, 3
SHARD = (
    "part int, shard int, start long, first_id long, last_id long, dict_sha256 string, "
    "doc_ids array<long>, offsets array<long>, n_tokens array<long>, frames binary"
)
NAMES = [c.split()[0] for c in SHARD.split(", ")]


def serialized(ids: bytes) -> bytes:
    """Two bytes an id; those of the vocabulary are below 65536."""
    got = np.frombuffer(ids, "<u4")
    if len(got) and got.max() > 65535:
        raise ValueError(f"id {got.max()} doesn't fit in two bytes")
    return got.astype("<u2").tobytes()


def _sampled(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([serialized(encode(t)[: 4 * LEAD]) for t in batch.column(0).to_pylist()], pa.binary())], ["ids"])


def train_dictionary(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> bytes:
    """The shared dictionary; made of plain content where there is too little to train on."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = one_text(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id"), "doc_id").select("text")
    samples = sorted(bytes(r[0]) for r in texts.mapInArrow(partial(_sampled, path=path), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _shards(batches: Iterator[pa.RecordBatch], raw: bytes, path: str | None) -> Iterator[pa.RecordBatch]:
    encode, sha = encoder(path), hashlib.sha256(raw).hexdigest()
    compress = zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(raw)).compress
    part, shard, done = TaskContext.get().partitionId(), 0, 0
    ids, sizes, frames, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal shard, done, ids, sizes, frames, held
        known = [i for i in ids if i is not None]
        ends = np.cumsum([0, *map(len, frames)]).tolist()
        row = [part, shard, done, min(known, default=None), max(known, default=None), sha, ids, ends, sizes, b"".join(frames)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], NAMES)
        shard, done = shard + 1, done + sum(sizes)
        ids, sizes, frames, held = [], [], [], 0
        return out

    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = encode(text.as_py()) + end
            frame = compress(serialized(got))
            ids.append(doc_id)
            sizes.append(len(got) // 4)
            frames.append(frame)
            held += len(frame) + 24
            if held >= SHARD_BYTES:
                yield flush()
    if ids:
        yield flush()


def write_files(scratch: Scratch, docs: DataFrame, dictionary: bytes, path: str | None = None) -> DataFrame:
    """The files of ``docs``, ordered by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # The text's hash parts rows of equal (or null) ids.
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return scratch.save(rows.mapInArrow(partial(_shards, raw=dictionary, path=path), SHARD), "tokens", compression="none")


def _documents(batches: Iterator[pa.RecordBatch], raw: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256(raw).hexdigest()
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_sha256"] != sha:
                raise ValueError("the file was written with another dictionary")
            out, at = [], row["start"]
            for doc_id, low, high, n in zip(row["doc_ids"], row["offsets"], row["offsets"][1:], row["n_tokens"], strict=False):
                ids = np.frombuffer(expand(row["frames"][low:high]), "<u2").astype("<u4")
                if len(ids) != n:
                    raise ValueError(f"document {doc_id}: {len(ids)} ids, {n} in the index")
                out.append((doc_id, row["part"], at, n, zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])


def read_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    rows = files.mapInArrow(partial(_documents, raw=dictionary, with_ids=False), "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    # One row per part: a running sum over at most as many rows as there are parts.
    sums = files.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_document(files: DataFrame, dictionary: bytes, doc_id: int) -> list[int]:
    """The ids of one document: its shard is found by the pushed-down id range, and only its frame is expanded."""
    place = F.array_position("doc_ids", doc_id).cast("int")
    low, high = F.get("offsets", place - 1), F.get("offsets", place)
    one = files.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).where(place > 0)
    frame = one.select(F.substring("frames", low.cast("int") + 1, (high - low).cast("int")).alias("frame"), "dict_sha256").first()
    if frame is None:
        raise KeyError(doc_id)
    if frame["dict_sha256"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the file was written with another dictionary")
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    return np.frombuffer(expand(bytes(frame["frame"])), "<u2").tolist()


def op3_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionary = train_dictionary(docs)
    return read_files(write_files(Scratch(spark, "tokenfiles"), docs, dictionary), dictionary)
