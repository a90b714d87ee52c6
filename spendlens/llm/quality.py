"""Quality by compression (operator 7).

Two zstandard dictionaries are trained on labelled text, one on good and one on bad. A text is compressed with each, in
equal parts of at most PART bytes that know nothing of one another, else a long text's own history would replace both
dictionaries; the difference of the two summed sizes, divided by the larger, says which kind of text it is made of. A
frame's fixed bytes weigh on short texts and draw their difference down. So a logistic curve over the difference and the
logarithm of the text's bytes (up to PART: beyond that, parts are alike), fitted on labelled rows that trained no
dictionary, turns it into the probability of label 1.

Only rows whose crc32(doc_id as text) mod 4 is not HELD_OUT are learned from: remainders 0 and 1 train the dictionaries,
3 the curve. Learning is bounded: of each label the SAMPLE rows with the lowest hash of doc_id, from each PIECES pieces
of PIECE characters spread evenly over the whole text. The curve's rows are weighted by the number of all rows of their
label over the sampled ones, so the bound doesn't change the mix of labels that it learns. Scoring reads every text whole.

Cases: null counts as empty; an empty text gets the curve's value at no difference and no length; without labels of both kinds every score is the
share of label 1 (0.5 without any), and ``accepted`` keeps all rows. Labels with null or another value than 0 and 1 are ignored; a doc_id with
several labels counts with the lowest, one with several texts with that of the lowest hash. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import one_text, table, text_of

HELD_OUT, THRESHOLD = 2, 0.7
SAMPLE, PIECES, PIECE = 4000, 4, 500
DICTIONARY_BYTES, LEVEL, PART = 131_072, 3, 2000


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    by_length: float
    offset: float


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def parts(raw: bytes) -> list[bytes]:
    """``raw`` in the fewest parts of at most PART bytes, of equal length but for one byte."""
    n = -(-len(raw) // PART)
    return [raw[k * len(raw) // n : (k + 1) * len(raw) // n] for k in range(n)]


def differences(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """(bad size - good size) / larger size of each text."""
    if not good or not bad:
        return np.zeros(len(texts))
    sizes = []
    for raw in (good, bad):
        compress = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress
        sizes.append(np.array([sum(len(compress(p)) for p in parts(t.encode())) or 1 for t in texts], float))
    return (sizes[1] - sizes[0]) / np.maximum(*sizes) if texts else np.zeros(0)


def lengths(texts: list[str]) -> np.ndarray:
    return np.log10(np.minimum([len(t.encode()) for t in texts], PART) + 10.0) if texts else np.zeros(0)


def curve(columns: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Slopes and offset of the weighted logistic curve of y, by Newton's method with a slight pull towards 0."""
    data = np.stack([*columns, np.ones(len(y))], axis=1)
    beta, weight = np.zeros(data.shape[1]), weight * len(y) / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        hessian = (data * (weight * p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hessian, data.T @ (weight * (y - p)) - 1e-3 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def _train(texts: list[str]) -> bytes:
    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text: its plain content is the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def _difference_rows(batches: Iterator[pa.RecordBatch], good: bytes, bad: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(differences(texts, good, bad)), pa.array(lengths(texts)), b.column(0)], ["x", "l", "y"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("y"))
    known = known.where(remainder() != HELD_OUT).withColumn("curve", remainder() == 3)
    count = {(r["y"], r["curve"]): r["count"] for r in known.groupBy("y", "curve").count().collect()}  # at most four
    chosen = None
    for y in (0, 1):
        for curve_ in (False, True):
            part = known.where((F.col("y") == y) & (F.col("curve") == curve_)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            chosen = part if chosen is None else chosen.unionByName(part)
    rows = one_text(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id"), "doc_id", "y", "curve")  # at most 4 * sample rows
    step = F.greatest((F.char_length("text") / PIECES).cast("int"), F.lit(PIECE))
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.col("text").substr(i * step + 1, F.lit(PIECE)))
    train = rows.where(~F.col("curve")).select("doc_id", "y", cut.alias("cut")).orderBy("doc_id").collect()
    good, bad = (_train([t for r in train if r["y"] == y for t in r["cut"]]) for y in (1, 0))
    got = rows.where("curve").select("y", "text").mapInArrow(partial(_difference_rows, good=good, bad=bad), "x double, l double, y long").orderBy("x", "l", "y").collect()
    y = np.array([r["y"] for r in got] or [r["y"] for r in train], int)
    all_of = {v: count.get((v, False), 0) + count.get((v, True), 0) for v in (0, 1)}
    weight = np.array([all_of[v] / min(sample, count[v, bool(got)]) for v in y])
    if not (good and bad) or len(set(y)) < 2:
        share = float(np.clip(np.average(y, weights=weight) if len(y) else 0.5, 0.001, 0.999))
        return Model(b"", b"", 0.0, 0.0, math.log(share / (1 - share)))
    return Model(good, bad, *curve([np.array([r[c] for r in got]) for c in "xl"], y, weight))


def scores(texts: list[str], model: Model) -> np.ndarray:
    z = model.slope * differences(texts, model.good, model.bad) + model.by_length * lengths(texts) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(b.column(2).to_pylist(), model))], ["doc_id", "held_out", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Model, text: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(scores([t or "" for t in b.column(text).to_pylist()], model) >= threshold))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), text_of().alias("text"))
    schema = rows.drop("text").schema.add("score", "double")
    return rows.mapInArrow(partial(_scored, model=model), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; all rows if the model has seen
    no labels of both kinds, as it then can't tell texts apart."""
    if not model.good:
        return docs
    return docs.mapInArrow(partial(_kept, model=model, text=docs.columns.index("text"), threshold=threshold), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))
