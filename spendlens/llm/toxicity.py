"""Toxicity by a classifier chain of linear models (operator 5).

``labels`` marks texts as toxic or not. The chain predicts three categories one after the other: ``repeated`` (toxic,
and a toxic term comes twice or more), ``dense`` (toxic, and toxic terms are at least every DENSE-th word) and ``toxic``
itself. Each model is a logistic regression on which chosen terms a text has, and on the probabilities of the
categories before it; while a later model is trained, those are out-of-fold predictions, so it sees them as wrong
as they will be on new text.

Terms are words and the first PREFIXES bytes of words (compounds with another ending count). Of all terms of the sample
the TERMS that part toxic from other texts best (chi squared) are kept. Learning is bounded: of either label the SAMPLE
rows with the lowest hash of doc_id, weighted by the number of all rows of the label over the sampled ones, so the bound
doesn't change the mix of labels that is learned. Every text is scored whole.

Cases: null counts as empty; a text without chosen terms has the intercepts' probability; without rows of both labels all
probabilities are the share of toxic rows (0 without any). Null labels are ignored; a doc_id with several labels is
toxic if one of them is. Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, one_text, table, text_of
from spendlens.llm.shingles import chunks, mix, multisets, word_hashes

SAMPLE, TERMS, FOLDS, PREFIXES, DENSE, LEAST = 6000, 3000, 3, (5, 7), 60, 4
CATEGORIES = ("repeated", "dense", "toxic")
_U = np.uint64


class Model(NamedTuple):
    terms: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # of each category: the terms, the categories before it, the intercept
    threshold: float  # of the last category: the best F1 of the out-of-fold predictions


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, count) of each text's words and prefixes, and each text's number of words."""
    doc, words = word_hashes(texts)
    docs, terms = [doc], [words]
    for n in PREFIXES:
        d, h = word_hashes(texts, first=n)
        docs.append(d)
        terms.append(mix(h ^ _U(n)))
    return *multisets(np.concatenate(docs), np.concatenate(terms)), np.bincount(doc, minlength=len(texts))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label have each term, summed within a part of a batch."""
    for whole in batches:
        for start, stop in chunks(whole.column(1)):
            batch = whole.slice(start, stop - start)
            doc, term, _, _ = terms_of(batch.column(1))
            toxic = np.asarray(batch.column(0)).astype(bool)[doc]
            kinds, at = np.unique(term, return_inverse=True)
            pos = np.bincount(at, weights=toxic, minlength=len(kinds)).astype(np.int64)
            both = np.bincount(at, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(pos), pa.array(both - pos)], ["term", "pos", "neg"])


def _rows(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, words, which chosen terms and how often."""
    for whole in batches:
        for start, stop in chunks(whole.column(2)):
            batch = whole.slice(start, stop - start)
            doc, at, count, words = chosen(batch.column(2), terms)
            order = np.argsort(doc, kind="stable")
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(batch)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v[order].astype(np.int32))) for v in (at, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.astype(np.int64)), *lists], ["doc_id", "y", "words", "at", "n"])


def chosen(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place in ``terms``, count) of the chosen terms of each text, and the numbers of words."""
    doc, term, count, words = terms_of(texts)
    if not len(terms):
        return doc[:0], doc[:0], count[:0], words
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    there = terms[at] == term
    return doc[there], at[there], count[there], words


def fit(doc: np.ndarray, at: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 150, pull: float = 1e-3) -> np.ndarray:
    """Logistic regression (weights of ``size`` terms, the extra columns, the intercept) by accelerated gradient steps."""
    n, k = extra.shape
    weight = weight * n / max(weight.sum(), 1e-9)
    w, before = np.zeros(size + k + 1), np.zeros(size + k + 1)
    # A step per coordinate, from how many rows have the term: rare terms learn as fast as common ones.
    scale = np.concatenate([np.bincount(at, weights=weight[doc], minlength=size), weight @ extra**2 + 1, [n]])
    widest = max(1, int(np.bincount(doc, minlength=n).max(initial=0)) + k + 1)
    rate = 4 / (np.sqrt(widest) * (scale / n + pull) + 1e-9)
    for step in range(steps):
        v = w + step / (step + 3) * (w - before)
        z = np.bincount(doc, weights=v[at], minlength=n) + extra @ v[size:-1] + v[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(at, weights=e[doc], minlength=size), extra.T @ e, [e.sum()]]) / n + pull * v
        before, w = w, v - rate * g / 4
    return w


def predict(doc: np.ndarray, at: np.ndarray, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    n, k = extra.shape
    z = np.bincount(doc, weights=w[at], minlength=n) + extra @ w[len(w) - k - 1 : -1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_chain(doc: np.ndarray, at: np.ndarray, categories: list[np.ndarray], weight: np.ndarray, fold: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One model per category; each gets the out-of-fold probabilities of those before it. Also those of the last."""
    extra, out = np.zeros((len(fold), 0)), []
    for y in categories:
        out.append(fit(doc, at, extra, y, weight, size))
        ahead = np.zeros(len(fold))
        for f in range(FOLDS):
            train, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            new = np.full(len(fold), -1)
            new[train] = np.arange(len(train))
            own = new[doc] >= 0
            w = fit(new[doc[own]], at[own], extra[train], y[train], weight[train], size)
            new[rest] = np.arange(len(rest))
            ahead[rest] = predict(new[doc[~own]], at[~own], extra[rest], w)
        extra = np.column_stack([extra, ahead])
    return out, extra[:, -1]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Half-way between the two neighbouring probabilities that part the weighted texts with the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal probabilities aren't parted
    cut = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][cut] + (p[order][cut + 1] if cut + 1 < len(p) else 0)) / 2)


def learn(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("long")).alias("y"))
    all_of = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    each = {v: n / min(sample, n) for v, n in all_of.items()}  # what a sampled row of the label stands for
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")
    rows = scratch.save(one_text(rows, "doc_id", "y"), "sample")  # at most 2 * sample rows
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not b:
        share = float(np.clip(a / max(1, a + b), 1e-6, 1 - 1e-6))
        base = np.log(share / (1 - share))
        return Model(np.zeros(0, np.uint64), [np.concatenate([np.zeros(k), [base]]) for k in range(len(CATEGORIES))], 0.5)
    counts = rows.select("y", "text").mapInArrow(_counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg, all_pos, all_neg = F.col("pos") * each[1], F.col("neg") * each[0], a * each[1], b * each[0]
    apart = pos * (all_neg - neg) - neg * (all_pos - pos)
    chi = apart * apart / ((pos + neg) * (all_pos + all_neg - pos - neg) + 1)
    best = counts.where(F.col("pos") + F.col("neg") >= LEAST).orderBy(chi.desc(), "term").limit(TERMS).select("term", "pos", "neg").collect()
    best = sorted((int(r["term"]) % 2**64, r["pos"] / a > 4 * r["neg"] / b) for r in best)
    terms, marks = np.array([t for t, _ in best], np.uint64), np.array([m for _, m in best], bool)
    got = rows.mapInArrow(partial(_rows, terms=terms), "doc_id long, y long, words long, at array<int>, n array<int>").orderBy("doc_id").collect()
    doc = np.repeat(np.arange(len(got)), [len(r["at"]) for r in got])
    at, n = (np.array([v for r in got for v in r[c]], np.int64) for c in ("at", "n"))
    y, words = (np.array([r[c] for r in got], float) for c in ("y", "words"))
    toxic_n = np.bincount(doc, weights=n * marks[at] if len(at) else n, minlength=len(got))
    most = np.zeros(len(got))
    np.maximum.at(most, doc, n * marks[at] if len(at) else n)
    categories = [y * (most >= 2), y * (toxic_n * DENSE >= words), y]
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) // 4 % FOLDS for r in got])
    weight = np.where(y > 0, each[1], each[0])
    weights, ahead = fit_chain(doc, at, categories, weight, fold, len(terms))
    return Model(terms, weights, best_threshold(ahead, y, weight))


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """One column per category; each model gets the probabilities before it."""
    doc, at, _, _ = chosen(texts, model.terms)
    extra = np.zeros((len(texts), 0))
    for w in model.weights:
        extra = np.column_stack([extra, predict(doc, at, extra, w)])
    return extra


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in chunks(whole.column(1)):
            batch = whole.slice(start, stop - start)
            p = probabilities(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in p.T]], ["doc_id", *[f"p_{c}" for c in CATEGORIES]])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_repeated, p_dense, p_toxic, toxic: one row per row of ``docs``."""
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = rows.select("doc_id").schema
    for c in CATEGORIES:
        schema = schema.add(f"p_{c}", "double")
    return rows.mapInArrow(partial(_scored, model=model), schema).withColumn("toxic", F.col("p_toxic") >= model.threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(Scratch(spark, "toxicity"), docs, table(spark, sf_dir, "labels")))
