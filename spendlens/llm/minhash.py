"""Near-duplicates by BagMinHash signatures of weighted word shingles (operator 2).

A text is the multiset of its runs of five words. BagMinHash sees each shingle of weight w as a Poisson process
over time and weight, cut into the dyadic weight intervals [0,1), [1,2), [2,4), ...; a signature component is the
time of the first point below the weight, so two signatures agree in a component with probability equal to the
weighted Jaccard similarity. Points are drawn in order of time and a process stops once its next point comes later
than every component, which is soon in all but short texts.

Texts with equal words share a node. Nodes that agree in a band of five components are candidates; their multisets
are compared in full. In a bucket of candidates not all pairs are formed: in each round some of its nodes (hubs) are
compared with the others that are not yet in the same class, until no two nodes of different classes are left
uncompared (first one hub, then a few from the middle of the largest class, then all nodes outside it). So a class is joined by every link among the candidates, and a large group costs about one comparison
for each of its members. After the first round a pair is left out only where it provably is no link: what no other
node has (``own``) cannot be shared, so the overlap of two nodes is at most the smaller of their other parts.

Cases: null counts as empty; a text without words is a class of its own; texts of fewer than five words have one
shingle of all their words; repeated rows are in one class; the lowest doc_id names the class and stays (null ids
last). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, same, table, text_of
from spendlens.llm.shingles import chunks, digests, mix, multisets, shingled, word_hashes

WIDTH, SIMILARITY = 5, (4, 5)  # words of a shingle; 4/5 as a ratio of integers
BANDS, ROWS = 20, 5
HUBS = 16  # of a class in the second round
DRAWN = 100_000  # items whose points are drawn together
KEY = ["doc_id", "tkey"]
_U = np.uint64
SIGNED = "doc_id long, tkey long, n_words long, node binary, bands array<long>"


def signatures(doc: np.ndarray, items: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size BagMinHash signatures of multisets given as (doc, item, count); inf for empty ones."""
    out = np.full(n * size, np.inf)
    for i in range(0, len(doc), DRAWN):  # a signature is a minimum over its items, in whatever parts they come
        _draw(out, doc[i : i + DRAWN], items[i : i + DRAWN], counts[i : i + DRAWN], n, size)
    return out.reshape(n, size)


def _draw(out: np.ndarray, doc: np.ndarray, items: np.ndarray, counts: np.ndarray, n: int, size: int) -> None:
    """Lowers ``out`` by the points of these items."""
    top = np.ceil(np.log2(counts)).astype(np.int64)  # the highest interval that begins below the count
    rep = np.repeat(np.arange(len(doc)), top + 1)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    length = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, length)
    state = mix(items[rep] + level.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    at, doc, weight = np.zeros(len(rep)), doc[rep], counts[rep]
    step = 0
    while len(doc):
        block = 1 if len(doc) > 50_000 else 16  # points drawn at once
        for _ in range(block):
            step += 1
            a = mix(state + _U(step * 0x9E3779B97F4A7C15 % 2**64))
            b = mix(a ^ _U(0x2545F4914F6CDD1D))
            at = at - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (length * size)
            part = ((b >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
            ok = low + ((b & _U(0xFFFFFFFF)).astype(np.int64) * length >> 32) < weight
            np.minimum.at(out, (doc * size + part)[ok], at[ok])
        left = at < out.reshape(n, size).max(axis=1)[doc]
        state, at, doc, weight, length, low = (x[left] for x in (state, at, doc, weight, length, low))


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in chunks(whole.column(2)):
            batch = whole.slice(start, stop - start)
            n = len(batch)
            doc, hashes = word_hashes(batch.column(2))
            node = np.empty((n, 2), np.uint64)
            node[:, 0], node[:, 1] = digests(doc, hashes, n)
            sig = signatures(*multisets(*shingled(doc, hashes, width, n)), n, bands * rows)
            keys = np.empty((n, bands), np.uint64)
            for b in range(bands):
                acc = np.full(n, b, np.uint64)
                for r in range(rows):
                    acc = mix(acc * _U(0x9E3779B97F4A7C15) + np.ascontiguousarray(sig[:, b * rows + r]).view(np.uint64))
                keys[:, b] = acc
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            nodes = pa.array([x.tobytes() for x in node], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), nodes, lists], ["doc_id", "tkey", "n_words", "node", "bands"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))


ITEMS = "node binary, items array<long>, counts array<int>"


def _items(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each node's multiset: its different shingles in ascending order, and how often it has each."""
    for whole in batches:
        for start, stop in chunks(whole.column(1)):
            batch = whole.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([batch.column(0), *bags(batch.column(1), width)], ["node", "items", "counts"])


def bags(texts: pa.Array, width: int = WIDTH) -> tuple[pa.Array, pa.Array]:
    doc, item, count = multisets(*shingled(*word_hashes(texts), width, len(texts)))
    order = np.lexsort((item, doc))
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(cuts, pa.array(v[order])) for v in (item.view(np.int64), count.astype(np.int32)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.offsets), np.asarray(column.values)


def overlaps(left: tuple[pa.Array, pa.Array], right: tuple[pa.Array, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sizes of the intersection and the union of two multisets. Fast where equal left ones follow each other."""
    (lo, li), (_, lc), (ro, ri), (_, rc) = (_lists(c) for c in (*left, *right))
    li, ri = li.view(np.uint64), ri.view(np.uint64)
    n = len(left[0])
    common = np.zeros(n, np.int64)
    start = 0
    while start < n:
        own = li[lo[start] : lo[start + 1]]
        stop = start + 1
        while stop < n and lo[stop + 1] - lo[stop] == len(own) and np.array_equal(own, li[lo[stop] : lo[stop + 1]]):
            stop += 1
        other = ri[ro[start] : ro[stop]]
        if len(own) and len(other):
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = np.where(own[at] == other, np.minimum(lc[lo[start] : lo[start + 1]][at], rc[ro[start] : ro[stop]]), 0)
            sums = np.concatenate([[0], np.cumsum(both)])
            common[start:stop] = sums[ro[start + 1 : stop + 1] - ro[start]] - sums[ro[start:stop] - ro[start]]
        start = stop
    total = lambda o, c: np.diff(np.concatenate([[0], np.cumsum(c)])[o])
    return common, total(lo, lc) + total(ro, rc) - common


def _verify(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            common, union = overlaps((batch.column(2), batch.column(3)), (batch.column(4), batch.column(5)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(common * similarity[1] >= union * similarity[0]))


def own_parts(scratch: Scratch, items: DataFrame) -> DataFrame:
    """(node, own): how much of each node's multiset no other of these nodes has; nodes with none are missing."""
    rows = items.select("node", F.explode(F.arrays_zip("items", "counts")).alias("x")).select("node", "x.*")
    single = rows.groupBy("items").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node"), F.sum("counts").alias("n")).where("nodes = 1")
    return scratch.save(single.groupBy("node").agg(F.sum("n").alias("own")), "own")


def components(scratch: Scratch, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, label): the lowest node of each node's connected component, over edges (a, b).

    Each step takes the lowest label among the neighbours and then the label of that label, so long paths shrink
    fast; every step is written, and only the count of changes comes to the driver. After so many ``steps``, a label
    is some node of the component: equal labels are in one component, but not the other way round.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = scratch.save(both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = scratch.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while steps is None or steps > 0:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.save(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = steps is not None or new.where("old <> label").limit(1).count()
        scratch.drop(labels)
        labels = new
        steps = None if steps is None else steps - 1
        if not changed:
            break
    scratch.drop(both)
    return labels.select("node", "label")


def near_duplicates(spark: SparkSession, docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, tkey, class_id (lowest doc_id of the class), class_size, kept: one row per row of ``docs``."""
    scratch = Scratch(spark, "minhash")
    signed = keyed(docs).mapInArrow(partial(_sign, width=width, bands=bands, rows=rows), SIGNED)
    signed = scratch.save(signed, "signed")
    # One row of each node; its text stands for all of them.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("one")
    size = F.greatest(F.min("n_words") - (width - 1), F.lit(1))
    nodes = signed.where("n_words > 0").groupBy("node").agg(one, size.alias("size"), F.first("bands").alias("bands"))
    nodes = scratch.save(nodes.select("node", "one.doc_id", "one.tkey", "size", "bands"), "nodes")
    in_bands = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    all_buckets = scratch.save(in_bands.join(shared, "bucket"), "buckets")
    wanted = all_buckets.select("node").distinct().join(nodes.select("node", *KEY), "node")
    own = keyed(docs)
    texts = wanted.hint("shuffle_hash").join(own, same(wanted, own, KEY)).select("node", own["text"])
    items = scratch.save(texts.mapInArrow(partial(_items, width=width), ITEMS).dropDuplicates(["node"]), "items")

    labels, edges, done, round_ = None, None, None, 1
    buckets = all_buckets
    while True:
        # What is still open: nodes that were no hub of their bucket yet, in buckets where these are of several classes.
        open_ = buckets if done is None else buckets.join(done, ["bucket", "node"], "left_anti")
        if labels is None:
            open_ = open_.withColumn("label", F.col("node"))
        else:
            open_ = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = open_.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        open_ = scratch.save(open_.join(mixed, "bucket"), "open")
        if open_.isEmpty():
            break
        if round_ == 2:  # from now on with what each open node has alone, and all its bands
            parts = own_parts(scratch, items.join(open_.select("node").distinct(), "node"))
            open_ = open_.join(parts, "node", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
            open_ = open_.where((F.col("size") - F.col("own")) * similarity[1] >= F.col("size") * similarity[0])
            open_ = open_.join(nodes.select("node", "bands"), "node").withColumn("band", F.array_position("bands", F.col("bucket")))
            open_ = scratch.save(open_, "open")
            buckets = open_.drop("label")
        if round_ == 1:
            chosen = open_.groupBy("bucket").agg(F.min("node").alias("node"))
            hubs = scratch.save(open_.join(chosen, ["bucket", "node"]), "hubs")
        else:
            # First a few hubs of each class that is a bucket's largest; there they test only the nodes outside the class.
            # Then all of these. A pair is formed in its first common bucket only, when one of its nodes is a hub there.
            sizes = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("largest"))
            ranked = open_.join(largest, "bucket")
            if round_ == 2:
                # Nodes with the least share of their own lie in the middle of their class: most links go through them.
                leading = ranked.where("label = largest.label and largest.n > 1")
                part = F.pmod(F.xxhash64("node"), F.lit(HUBS))
                middle = F.min(F.struct((F.col("own") / F.col("size")).alias("share"), "node"))["node"]
                hubs = leading.join(leading.groupBy("label", part.alias("part")).agg(middle.alias("node")).select("node"), "node")
            else:
                hubs = ranked.where("label <> largest.label")
            hubs = scratch.save(hubs.select(*open_.columns), "hubs")
        pairs = open_.join(hubs.select("bucket", F.struct(*[c for c in hubs.columns if c != "bucket"]).alias("hub")), "bucket")
        pairs = pairs.where(F.col("label") != F.col("hub.label"))
        if round_ == 1:
            shared = F.least("size", "hub.size")
        else:
            shared = F.least(F.col("size") - F.col("own"), F.col("hub.size") - F.col("hub.own"))
        pairs = pairs.where(shared * similarity[1] >= (F.col("size") + F.col("hub.size") - shared) * similarity[0])
        if round_ > 1:
            equal = F.zip_with("bands", "hub.bands", lambda x, y: x == y)
            pairs = pairs.where(F.array_position(equal, True) == F.col("band"))
        pairs = pairs.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()
        pairs = pairs.join(items.select(F.col("node").alias("b"), F.col("items").alias("ri"), F.col("counts").alias("rc")), "b")
        pairs = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("li"), F.col("counts").alias("lc")), "a")
        pairs = pairs.select("a", "b", "li", "lc", "ri", "rc")
        links = scratch.save(pairs.mapInArrow(partial(_verify, similarity=similarity), "a binary, b binary"), "links")
        edges = links if edges is None else scratch.save(edges.unionByName(links), "links")
        labels = components(scratch, edges, steps=2)
        used = hubs.select("bucket", "node")
        done = used if done is None else scratch.save(done.unionByName(used), "done")
        round_ += 1

    if edges is not None:
        labels = components(scratch, edges)
    rows_ = signed.select(*KEY, "n_words", "node")
    if labels is not None:
        rows_ = rows_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        rows_ = rows_.withColumn("label", F.col("node"))
    rows_ = scratch.save(rows_.drop("node"), "rows")
    scratch.drop(items, all_buckets)
    classes = rows_.where("n_words > 0").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), one)
    out = rows_.join(classes, (rows_["label"] == classes["label"]) & (rows_["n_words"] > 0), "left").drop(classes["label"])
    first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("tkey") == F.col("one.tkey"))
    alone = F.col("n_words") == 0
    return out.select(
        *KEY, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (alone | first).alias("kept"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("tkey")
