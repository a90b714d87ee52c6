"""Training and scoring of many rows: rows are counted by the places that they hold, terms are looked up where the texts are."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from spendlens.operators import forest, ml
from spendlens.plans import catalog_ml
from spendlens.schema import TRANSACTIONS

SIZE, LABELS = 40, 3


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _batch(n: int, often: int):
    """Rows that hold some of SIZE places; the first ``often`` places are held by most rows."""
    rng = np.random.default_rng(n + often)
    held = [sorted({*np.flatnonzero(rng.random(often) < 0.8).tolist(), *rng.integers(often, SIZE, 3).tolist()}) for _ in range(n)]
    values = [rng.random(len(h)).tolist() for h in held]
    arrays = [pa.array(np.arange(n) * 7), pa.array(rng.integers(0, LABELS, n).astype(np.int32)), pa.array(held, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
    return held, values, pa.RecordBatch.from_arrays(arrays, names=["id", "label", "i", "v"])


@pytest.mark.parametrize("often", [1, 30])
def test_counts_of_a_level_are_those_of_each_row(often):
    """Against a walk of each row down each tree; totals come from the roots alone, as the others are known from the splits."""
    held, values, batch = _batch(600, often)
    rng, grown = np.random.default_rng(4), []
    for t in range(5):
        nodes, levels = [1], []
        for _ in range(t):
            levels.append((np.array(nodes), rng.integers(0, SIZE, len(nodes)), rng.integers(0, 25, len(nodes))))
            nodes = sorted(c for x in nodes for c in (2 * x, 2 * x + 1) if c % 5)
        grown.append((levels, np.array(nodes)))
    kept = forest.Forest(SIZE, {}, [levels for levels, _ in grown])
    for drawn in (4, SIZE):  # with all places drawn for many nodes, each place is looked at once for all of them
        want, ids = Counter(), np.asarray(batch["id"])
        for t, (levels, nodes) in enumerate(grown):
            copies = forest._copies(ids, t, 9)
            splits = {int(x): (int(p), int(b)) for lev in levels for x, p, b in zip(*lev, strict=True)}
            draws = {int(x): set(forest._drawn(9, t, int(x), SIZE, drawn).tolist()) for x in nodes}
            for r, c in enumerate(copies.tolist()):
                bins, node, label = {p: int(np.ceil(v * 31)) for p, v in zip(held[r], values[r], strict=True)}, 1, batch["label"][r].as_py()
                while node in splits:
                    node = 2 * node + (bins.get(splits[node][0], 0) > splits[node][1])
                if c and node in draws:
                    if node == 1:
                        want[t << 32 | node, label - LABELS] += c
                    for p in draws[node] & set(bins):
                        want[t << 32 | node, ((p << 6) | bins[p]) * LABELS + label] += c
        got = Counter()
        for b in forest._counting(kept, [nodes for _, nodes in grown], SIZE, drawn, LABELS, 9)(iter(batch.slice(k, 250) for k in (0, 250, 500))):
            for r in b.to_pylist():
                got.update({(r["node"], k): n for k, n in zip(r["keys"], r["n"], strict=True)})
        assert got == want and any(k < 0 for _, k in got) and all(node & 0xFFFFFFFF == 1 for node, k in got if k < 0)


def test_nodes_without_rows_at_their_places_are_leaves(spark):
    """Labels that differ, but no place that any row has: each tree is its root's shares."""
    rows = spark.createDataFrame([(i, i % 2, [], []) for i in range(40)], "id long, label int, i array<int>, v array<double>")
    grown = forest.grow(rows, 30, 30, [1.0, 1.0], 3, 4, 1)
    assert [nodes.tolist() for nodes, _ in grown.leaves] == [[1]] * 3 and all(abs(s.sum() - 1) < 1e-9 for _, s in grown.leaves)


def test_a_large_vocabulary_moves_no_rows(spark):
    """250,000 terms, more than are joined by a broadcast: each task looks up its own, the texts are shuffled once to find the different ones."""
    n = 250_000
    vocab = spark.range(n).selectExpr("concat('w', lpad(id, 7, '0')) AS term", "2L AS df", "1.0D + id / 1000000 AS idf", "id AS index")
    docs = spark.createDataFrame([("w0000003 w0249999 w0000003",), ("unknown W0000001",), ("w0000003 w0249999 w0000003",), ("none",), ("",), (None,)], "text string")
    vectors = ml.tfidf_vectors(docs, vocab)
    assert "Join" not in _plan(vectors) and _plan(vectors).count("Exchange (") <= 2  # named in the tree and in the list
    a, b = 2 * 1.000003, 1.249999
    norm = (a * a + b * b) ** 0.5
    got = {r.text: (r.indices, r["values"]) for r in vectors.collect()}
    assert set(got) == {"w0000003 w0249999 w0000003", "unknown W0000001"} and got["unknown W0000001"] == ([1], [1.0])
    assert got["w0000003 w0249999 w0000003"][0] == [3, 249999] and got["w0000003 w0249999 w0000003"][1] == pytest.approx([a / norm, b / norm])
    terms = {(r.text, r.term): r.weight for r in ml.tfidf_transform(docs, vocab.drop("index")).collect()}
    assert terms == pytest.approx({("w0000003 w0249999 w0000003", "w0000003"): a / norm, ("w0000003 w0249999 w0000003", "w0249999"): b / norm, ("unknown W0000001", "w0000001"): 1.0})
    rows = spark.createDataFrame([(dt.date(2024, 1, 5), "w0000007", "x", -1.0, "c", "p", "b", "CAD")], TRANSACTIONS)
    model = ml.Model(vocab, PipelineModel(stages=[]), forest.Forest(n, {}), n, [], vocab)
    made = model.features(rows)
    assert "Exchange" not in _plan(made) and made.first()._tfidf.indices.tolist() == [7] and made.first()._tfidf.size == n


def test_words_of_two_texts_make_no_pair(spark):
    vocab = spark.createDataFrame([("aa bb", 2, 1.0), ("bb cc", 2, 1.0)], "term string, df long, idf double")
    docs = spark.createDataFrame([("aa bb",), ("cc",), ("cc bb cc",)], "text string").coalesce(1)
    assert {(r.text, r.term) for r in ml.tfidf_transform(docs, vocab).collect()} == {("aa bb", "aa bb"), ("cc bb cc", "bb cc")}


def test_ml_train_grows_the_whole_forest(spark, monkeypatch):
    """As many trees as the reference, and no flatter ones than the stored model has."""
    asked = {}
    monkeypatch.setattr(ml, "train_model", lambda rows, **how: asked.update(how) or (type("M", (), {"report": rows}), rows))
    monkeypatch.setattr(catalog_ml, "txn", lambda spark, sf_dir: spark.range(1).select(F.col("id")))
    catalog_ml.q_ml_train(spark, "nowhere")
    assert asked["num_trees"] == 250 and asked["max_depth"] == catalog_ml.MAX_DEPTH
