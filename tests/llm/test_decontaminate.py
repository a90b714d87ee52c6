"""Operator 1 against a plain-Python reading of the contract."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from spendlens.llm import decontaminate as D
from spendlens.llm.common import LOWER, UPPER, Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k and item is not None else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, item_id string, term long")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, D.decontaminate(spark, d, b).drop("tkey").collect()), key=str)


def near(docs, items, slop=8, rarest=3):
    """{doc_id: items with a proximity match}, by trying all starts of all windows."""
    words_of = [(i, words(t)) for i, t in docs]
    df = Counter(w for _, ws in words_of for w in ws)
    windows = set()
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k and item is not None else 0):
            if all(x in df for x in w[s : s + k]):
                rare = sorted(range(s, s + k), key=lambda q: (df[w[q]], q))[:rarest]
                windows.add((item, tuple((q, w[q]) for q in sorted(rare))))
    out = Counter()
    for i, ws in words_of:
        places = {}
        for p, w in enumerate(ws):
            places.setdefault(w, []).append(p)
        found = set()
        for item, terms in windows:
            starts = [[p - q for p in places.get(w, [])] for q, w in terms]
            if all(starts) and any(all(any(a <= b <= a + slop for b in other) for other in starts) for a in {x for one in starts for x in one}):
                found.add(item)
        out[i] = len(found)
    return out


def test_small_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = [
        (1, "Intro. " + item.upper() + " -- end"), (2, item), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (6, "!!!"),
        (7, "x " * 500 + item), (8, item), (8, item), (None, item), (9, "short item"), (10, "a short, ITEM: b " * 3),
        (11, " ".join(item.split()[2:])), (12, "Één één " + item), (13, "word " * 20000 + item + " word" * 20000), (14, "na na na " * 30),
    ]
    items = [(1, item), (1, item), (2, "short item"), (3, None), (4, "..."), (None, item), (5, "na " * 20), (6, "absent words only here")]
    assert run(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    b = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").select("item_id", "text").collect()
    got = D.op1_decontaminate(spark, f"/root/testdata/{sf}")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    want = brute([tuple(r) for r in d], [tuple(r) for r in b])
    rows = got.collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want)
    assert {r["doc_id"]: r["n_near"] for r in rows} == near([tuple(r) for r in d], [tuple(r) for r in b])
    assert any(r["n_near"] for r in rows) and all(r["n_near"] >= r["n_items"] for r in rows)
    assert any(r[5] for r in want)


def test_proximity(spark):
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 40 + "beta gamma")], "doc_id long, text string")
    items = D.test_items(scratch, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    got = D.proximity_matches(scratch, D.build_index(scratch, docs), items, slop=6)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_proximity_beside_exact_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    moved = "one two three four five SIX seven x eight nine ten eleven y twelve thirteen z"
    docs = [(1, item), (2, moved), (3, " far away ".join(item.split())), (4, "nothing like it"), (5, None), (None, moved)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.decontaminate(spark, d, spark.createDataFrame([(7, item), (8, item), (9, "unknown words")], "item_id long, text string"), proximity=True)
    want = near(docs, [(7, item), (8, item), (9, "unknown words")])
    assert {r["doc_id"]: (r["n_items"], r["n_near"]) for r in got.collect()} == {i: (2 if i == 1 else 0, want[i]) for i, _ in docs}
    assert want[1] == want[2] == 2 and want[4] == 0
