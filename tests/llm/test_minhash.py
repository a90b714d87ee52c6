"""Operator 2: unbiased signatures, exact overlaps, and classes against all pairs on small tables."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from spendlens.llm import minhash as M
from spendlens.llm import shingles as S
from tests.llm.test_decontaminate import words


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts, least=0.8):
    """Class of each text by comparing all pairs that share a shingle."""
    label = list(range(len(texts)))
    bags = [bag(t) for t in texts]
    having = {}
    for i, b in enumerate(bags):
        for x in b:
            having.setdefault(x, []).append(i)
    for i, j in sorted({p for ids in having.values() for p in itertools.combinations(ids, 2)}):
        if label[i] != label[j] and jaccard(bags[i], bags[j]) >= least:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_words_and_overlaps_match_plain_python():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("Aa bé Ç x1 2 -- ñandú ' Z").split(" ")[0] + rnd.choice(["", " ", "a", "É"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", None, "x"]
    other = texts[1:] + texts[:1]
    doc, _ = S.word_hashes(pa.array(texts))
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
    common, union = M.overlaps(M.bags(pa.array(texts)), M.bags(pa.array(other)))
    for a, b, c, u in zip(texts, other, common, union, strict=True):
        assert (c, u) == (sum((bag(a) & bag(b)).values()), sum((bag(a) | bag(b)).values()))


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng, errors = np.random.default_rng(5), []
    for k in range(0, 12_000, 100):  # other items, so other points, in each trial
        a = k + rng.integers(0, 40, 300)
        b = a.copy()
        b[: rng.integers(5, 250)] = k + rng.integers(0, 40)
        sig = M.signatures(*S.multisets(np.repeat([0, 1], 300), np.concatenate([a, b]).astype(np.uint64)), 2, 256)
        errors.append((sig[0] == sig[1]).mean() - jaccard(Counter(a.tolist()), Counter(b.tolist())))
    assert abs(np.mean(errors)) < 0.008 and np.std(errors) < 0.06


def test_classes_match_all_pairs(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for n in (8, 30, 60, 200):
        for _ in range(4):
            base = [rnd.choice(vocab) for _ in range(n)]
            for _ in range(rnd.randint(1, 6)):  # near copies of the base, at various distances
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, n // 25))):
                    copy[rnd.randrange(n)] = rnd.choice(vocab)
                texts.append(" ".join(copy))
    texts += ["", None, "!!!", "a b", "A, b!", "la la " * 300, "la la " * 301, texts[0], texts[0].upper()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, node int")
    got = M.near_duplicates(spark, docs).drop("tkey").collect()
    assert len(got) == len(texts) + 1
    mine = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    want = classes(texts)
    assert [mine[i] for i in range(len(texts))] == want
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(set(want))


def test_chain_of_links_in_one_bucket(spark):
    """A chain of texts of which only neighbours are similar is one class, though the first hub misses most."""
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base[k * 6 : k * 6 + 200]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(spark, docs).collect()}
    assert [got[i] for i in range(12)] == classes(texts) == [0] * 12


def test_empty_table_and_repeated_rows(spark):
    assert M.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {r["class_size"] for r in M.near_duplicates(spark, docs).collect()} == {2}


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = [rows[k][0] for k in classes([t for _, t in rows])]
    got = {r["doc_id"]: r["class_id"] for r in M.op2_minhash(spark, sf).collect()}
    missed = sum(got[i] != c for (i, _), c in zip(rows, want, strict=True))
    assert missed == 0
