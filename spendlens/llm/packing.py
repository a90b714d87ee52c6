"""Pattern packing by non-negative least squares (operator 8).

Documents become pieces of at most SIZE ids. Patterns are all sets of up to three lengths that fill a sequence exactly;
how often each is used is fitted to the histogram of lengths by non-negative least squares, rounded, and taken as far
as the counts go. What is left over is packed by best fit, longest first, on the histogram. The plan depends on the
histogram alone (at most SIZE rows on the driver): it gives each length's ranks their sequence and offset. Ranks are
counted where the pieces are made and summed per part, so no length is gathered in one task.

Null text counts as empty: one piece, the separator. Repeated rows are packed each. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, table, text_of
from spendlens.llm.tokens import encoder

SIZE, SEPARATOR_ID, STEPS = 2048, 0, 60
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(batches: Iterator[pa.RecordBatch], size: int, path: str | None) -> Iterator[pa.RecordBatch]:
    encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
    end = np.array([SEPARATOR_ID], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py()) + end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                own = ids[at : at + 4 * size]
                n = len(own) // 4
                rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                seen[n] += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All rows (a >= b >= c) of up to three of the lengths with a + b + c = size; 0 stands for no document."""
    there = np.zeros(size + 1, bool)
    there[[0, *lengths]] = True
    out = []
    for a in lengths:
        b = np.flatnonzero(there[: min(a, size - a) + 1])
        c = size - a - b
        ok = (c >= 0) & (c <= b)
        ok[ok] &= there[c[ok]]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that lowers ||A x - counts||, A the lengths of each pattern, by multiplicative least-squares steps."""
    size = len(counts)
    weight = counts.astype(float)
    weight[0] = 0  # no document: nothing to fit
    given = lambda v: v[rows].sum(axis=1)  # noqa: E731  A' v
    x = np.full(len(rows), max(1.0, weight.sum()) / max(1, 3 * len(rows)))
    goal = given(weight)
    for _ in range(steps):
        made = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=size)
        made[0] = 0
        x *= goal / np.maximum(given(made), 1e-12)
    return x


def packs(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use every piece of the histogram once."""
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    rows = patterns(np.flatnonzero(left[1:]) + 1, size)
    x = fitted(rows, left)
    out: Counter = Counter()
    rest = left.tolist()
    for i in np.argsort(-x, kind="stable").tolist():
        own = [n for n in rows[i].tolist() if n]
        need = Counter(own)
        n = min([max(1, round(float(x[i]))), *[rest[k] // v for k, v in need.items()]])
        if n:
            out[tuple(own)] += n
            for k, v in need.items():
                rest[k] -= n * v
    # Best fit of the rest, longest first: sequences with the same content are counted together.
    open_: list[Counter] = [Counter() for _ in range(size + 1)]  # by room that is left
    for n in range(size, 0, -1):
        while rest[n]:
            room = next((r for r in range(n, size) if open_[r]), size)
            if room == size:
                each = min(size // n, rest[n])
                times, own = rest[n] // each, (n,) * each
                rest[n] -= times * each
            else:
                base, held = next(iter(open_[room].items()))
                each = min(room // n, rest[n])
                times, own = min(held, rest[n] // each), base + (n,) * each
                open_[room][base] -= times
                if not open_[room][base]:
                    del open_[room][base]
                rest[n] -= times * each
            open_[size - sum(own)][own] += times
    for held in open_:
        out.update(held)
    return sorted(out.items())


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sequence, offset), sorted by key = length << 44 | first rank of a run of pieces in like sequences."""
    used, keys, first, offsets, sequence = Counter(), [], [], [], 0
    for own, times in packs(histogram, size):
        at = 0
        for n in own:
            keys.append(n << 44 | used[n])
            first.append(sequence)
            offsets.append(at)
            used[n] += times
            at += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(v, np.int64)[order] for v in (keys, first, offsets))


def _placed(batches: Iterator[pa.RecordBatch], plan_) -> Iterator[pa.RecordBatch]:
    keys, first, offsets = plan_.value
    for batch in batches:
        own = np.asarray(batch.column(3)) << 44 | np.asarray(batch.column(5))
        at = np.searchsorted(keys, own, side="right") - 1
        got = [pa.array(first[at] + own - keys[at]), pa.array(offsets[at])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *got], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = scratch.save(rows.mapInArrow(partial(_pieces, size=size, path=path), PIECES), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    shared = spark.sparkContext.broadcast(plan(histogram, size))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, plan_=shared), out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
