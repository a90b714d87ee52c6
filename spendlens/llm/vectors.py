"""Near-duplicate embeddings by an epsilon grid order join (operator 12).

Vectors with cosine >= s lie at most eps = sqrt(2 - 2 s) apart once they have length 1, and a rotation keeps distances.
All different vectors are rotated to the leading principal dimensions of their second moments, put into grid cells of
width eps there, and sorted by cell (a sampled range sort, so a hot cell spreads over as many ranges as it needs). A
range of the sequence is an interval with a box. Pairs of intervals are refined from the whole sequence downwards, in
Spark down to the ranges and inside the tasks down to runs of LEAF vectors; a pair whose boxes are more than eps apart is
skipped with all below it. What remains is compared by matrix products in single precision; whatever these leave in
doubt by their rounding is decided by the cosine in double precision.

A task takes one pair of ranges, at most twice RANGE_BYTES: the number of ranges grows with the data. It never emits
pairs: only each vector's number of links and, for the components, one edge to a representative for each linked vector.

Cases: equal vectors are one node that counts for all its rows (they link with each other); vectors that are null, of
length zero, or hold null or non-finite numbers link with nothing; vectors of different dimension don't link; null ids
count as rows but name no component (one of null ids only has a null id); repeated ids are rows of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, small, table
from spendlens.llm.minhash import components

SIMILARITY = 0.9
LEAD = 8  # principal dimensions in the grid
RANGE_BYTES, RANGES = 32_000_000, 8  # a range holds about so much at most; so many ranges at least
LEAF, FAN = 512, 16  # vectors of the smallest interval; intervals of a level that make one of the next
SLACK = 1e-5  # rounding of places and boxes


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x size matrix in double precision, padded with zeros; lengths)."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), np.float64)
    if len(lengths) and (lengths == size).all():
        return values.reshape(len(lengths), size), lengths
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out, lengths


def _units(matrix: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that neither large nor tiny numbers overflow when squared."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def nodes_of(scratch: Scratch, vectors: DataFrame, id_col: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k1, k2, null keys where a vector links with nothing; nodes: k1, k2, copies, low, vector)."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), v))
    rows = rows.select("id", "vector", F.when(v.isNotNull(), F.xxhash64(v)).alias("k1"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), v)).alias("k2"))
    nodes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.first("vector").alias("vector"))
    return rows.drop("vector"), scratch.save(nodes, "nodes")


def leading_dimensions(nodes: DataFrame, size: int, lead: int) -> np.ndarray:
    """size x lead: the principal directions of all nodes; only sums over dimensions come to the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            units = _units(_matrix(batch.column(0), size)[0])
            total += units.T @ units
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    sums = nodes.select("vector").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    matrix = np.zeros((size, size))
    matrix[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("x").to_numpy()
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1][:, :lead]


def in_grid_order(scratch: Scratch, nodes: DataFrame, size: int, eps: float, lead: int, ranges: int) -> DataFrame:
    """node (a number), copies, low, k1, k2, vector, place (array<double>), part (its range in the sequence)."""
    axes = leading_dimensions(nodes, size, lead)
    names = ["copies", "low", "k1", "k2", "vector"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                place = _units(_matrix(batch.column(4), size)[0]) @ axes
                cuts = pa.array(np.arange(0, place.size + 1, place.shape[1], dtype=np.int32))
                cells = pa.ListArray.from_arrays(cuts, pa.array(np.floor(place / eps).astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(place.ravel())), cells], [*names, "place", "cells"])

    kind = nodes.schema["vector"].dataType.simpleString()
    rows = nodes.select(*names).mapInArrow(placed, f"copies long, low long, k1 long, k2 long, vector {kind}, place array<double>, cells array<int>")
    order = ["cells", "place", "k1", "k2"]
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = scratch.save(rows.select(F.monotonically_increasing_id().alias("node"), *names, "place", F.spark_partition_id().alias("dealt")), "sequence")
    # Ranges of equal length, however many partitions the sort had: a node's number in its partition, and what comes before (a row a partition).
    counts = rows.groupBy("dealt").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    before = counts.select("dealt", "first", (F.sum("n").over(Window.orderBy("dealt")) - F.col("n")).alias("before"))
    number = F.col("node") - F.col("first") + F.col("before")
    total = max(rows.count(), 1)
    return rows.join(small(before), "dealt").withColumn("part", F.floor(number * ranges / total).cast("int")).drop("dealt", "first", "before")


def near_ranges(scratch: Scratch, sequence: DataFrame, eps: float, lead: int) -> DataFrame:
    """(a, b) with a <= b: the pairs of ranges whose boxes are at most eps apart, found from the whole sequence downwards."""
    low = [F.min(F.get("place", F.lit(i))).alias(f"l{i}") for i in range(lead)]
    high = [F.max(F.get("place", F.lit(i))).alias(f"h{i}") for i in range(lead)]
    levels = [scratch.save(sequence.groupBy(F.col("part").cast("long").alias("part")).agg(*low, *high), "boxes")]
    top = levels[0].agg(F.max("part")).first()[0]
    while top:
        up = levels[-1].groupBy((F.col("part") / FAN).cast("long").alias("part"))
        levels.append(scratch.save(up.agg(*[F.min(f"l{i}").alias(f"l{i}") for i in range(lead)], *[F.max(f"h{i}").alias(f"h{i}") for i in range(lead)]), "boxes"))
        top //= FAN
    pairs = levels[-1].select(F.col("part").alias("a"), F.col("part").alias("b"))
    for boxes in reversed(levels[:-1]):
        kids = boxes.withColumn("up", (F.col("part") / FAN).cast("long"))
        left, right = (kids.select(F.col("up").alias(s), F.col("part").alias(f"{s}_"), *[F.col(c).alias(f"{s}{c}") for c in boxes.columns if c != "part"]) for s in "ab")
        gap = sum((F.pow(F.greatest(F.col(f"al{i}") - F.col(f"bh{i}"), F.col(f"bl{i}") - F.col(f"ah{i}"), F.lit(0.0)), 2) for i in range(lead)), F.lit(0.0))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("a_") <= F.col("b_")) & (gap <= (eps + SLACK) ** 2)).select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    return pairs


class Joined:
    """The links between the vectors of one pair of ranges, or inside one range."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray, place: np.ndarray, copies: np.ndarray, similarity: float):
        self.exact, self.lengths, self.place, self.copies = _units(vectors), lengths, place, copies
        self.units, self.similarity = self.exact.astype(np.float32), similarity
        self.eps = np.sqrt(2 - 2 * similarity) + SLACK
        self.doubt = 1e-6 + 2.0**-22 * vectors.shape[1]  # more than single precision can be off
        self.mixed = len(lengths) > 0 and lengths.min() != lengths.max()
        self.links, self.root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))

    def run(self, cut: int) -> None:
        """Joins the first ``cut`` vectors with the others, or all with each other if there are no others."""
        n = len(self.links)
        first = [(i, min(i + LEAF, cut)) for i in range(0, cut, LEAF)]
        second = [(i, min(i + LEAF, n)) for i in range(cut, n, LEAF)]
        boxes = {x: (self.place[slice(*x)].min(axis=0), self.place[slice(*x)].max(axis=0)) for x in first + second}
        self._pair(first, second or first, boxes, not second)

    def _pair(self, left: list, right: list, boxes: dict, own: bool) -> None:
        """own: left and right are the same interval, so each pair in it is met once."""
        if own and len(left) > 1:
            half = len(left) // 2
            self._pair(left[:half], left[:half], boxes, True)
            self._pair(left[half:], left[half:], boxes, True)
            self._pair(left[:half], left[half:], boxes, False)
            return
        (al, ah), (bl, bh) = ((np.min([boxes[x][0] for x in side], axis=0), np.max([boxes[x][1] for x in side], axis=0)) for side in (left, right))
        if not own and np.square(np.maximum(np.maximum(al - bh, bl - ah), 0)).sum() > self.eps**2:
            return
        if len(left) == len(right) == 1:
            self._compare(slice(*left[0]), slice(*right[0]), own)
        elif len(left) >= len(right):
            self._pair(left[: len(left) // 2], right, boxes, False)
            self._pair(left[len(left) // 2 :], right, boxes, False)
        else:
            self._pair(left, right[: len(right) // 2], boxes, False)
            self._pair(left, right[len(right) // 2 :], boxes, False)

    def _compare(self, a: slice, b: slice, own: bool) -> None:
        dots = self.units[a] @ self.units[b].T
        linked = dots >= self.similarity + self.doubt
        open_ = (dots >= self.similarity - self.doubt) & ~linked
        if open_.any():
            i, j = np.nonzero(open_)
            linked[i, j] = np.einsum("ij,ij->i", self.exact[a][i], self.exact[b][j]) >= self.similarity
        if self.mixed:
            linked &= self.lengths[a][:, None] == self.lengths[b][None, :]
        if own:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.links[a] += linked @ self.copies[b]
        if not own:
            self.links[b] += linked.T @ self.copies[a]
        i, j = np.nonzero(linked & (self.root[a][:, None] != self.root[b][None, :]))
        while len(i):  # each round unites at least one pair of components
            x, y = self.root[a][i], self.root[b][j]
            target = np.arange(len(self.root))
            np.minimum.at(target, np.maximum(x, y), np.minimum(x, y))
            while (target[target] != target).any():
                target = target[target]
            self.root = target[self.root]
            apart = self.root[a][i] != self.root[b][j]
            i, j = i[apart], j[apart]


def links(sequence: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """node, links (rows linked with it, its copies aside), root (a node of its component): one row per task and linked node."""

    def joined(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        rows = rows.take(pa.array(np.lexsort((rows.column("node").to_numpy(), side))))
        vectors, lengths = _matrix(rows.column("vector").combine_chunks(), size)
        place = _matrix(rows.column("place").combine_chunks(), len(rows.column("place")[0]))[0]
        work = Joined(vectors, lengths, place, rows.column("copies").to_numpy(), similarity)
        work.run(int((side == 0).sum()))
        node, hit = rows.column("node").to_numpy(), np.flatnonzero(work.links)
        return pa.table({"node": node[hit], "links": work.links[hit], "root": node[work.root[hit]]})

    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("part", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")).cast("int"))
    dealt = sequence.select("node", "copies", "vector", "place", "part").join(sides, "part").select("a", "b", "side", "node", "copies", "vector", "place")
    return dealt.groupBy("a", "b").applyInArrow(joined, "node long, links long, root long")


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", similarity: float = SIMILARITY, lead: int = LEAD, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``; ``similarity`` above 0."""
    scratch = Scratch(spark, "vectors")
    rows, nodes = nodes_of(scratch, vectors, id_col, column)
    facts = nodes.agg(F.max(F.size("vector")), F.sum(F.size("vector"))).first()
    size, numbers = int(facts[0] or 0), int(facts[1] or 0)
    if not size:
        found = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        eps, lead = float(np.sqrt(2 - 2 * similarity)), min(lead, size)
        ranges = max(RANGES, -(-numbers * 8 // range_bytes))
        sequence = in_grid_order(scratch, nodes, size, eps, lead, ranges)
        linked = scratch.save(links(sequence, near_ranges(scratch, sequence, eps, lead), size, similarity), "links")
        labels = components(scratch, linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        per_node = sequence.select("node", "copies", "low", "k1", "k2").join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(labels, "node", "left")
        per_node = per_node.withColumn("label", F.coalesce("label", "node"))
        per_node = scratch.save(per_node, "counted")
        names = per_node.groupBy("label").agg(F.min("low").alias("component_id"))
        per_node = per_node.join(names, "label").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        none = F.col("k1").isNull()  # links with nothing
        found = rows.join(scratch.save(per_node, "named"), ["k1", "k2"], "left").select(
            "id", F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
        )
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1),
f AS (SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id FROM v JOIN c USING (r) LEFT JOIN n USING (r)
 UNION ALL SELECT vec_id, 0, vec_id FROM embeddings
 WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM f
"""
