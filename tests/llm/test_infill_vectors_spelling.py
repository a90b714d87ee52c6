"""Operators 11 to 13 against plain Python: null, empty, long, repeated and odd rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlens.llm import infill, spelling, vectors
from spendlens.llm.common import Scratch, table
from tests.conftest import SF_SMALL

TEXTS = "doc_id long, text string, key string, n int, word string, form string"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def filled(doc_id, text):
    text = text or ""
    units, key = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def odd_texts():
    base = [None, "", " ", "\n\t", "a", " a", "a ", "a\x0b\x0cb\r\n c", "x<P>y z", "x <S", "<M>", "a < b <p> <", "tail<", " nb sp   wide", "\U0001f600 \U0001f601\U0001f602 é", "$1 \\1 {2}+ (a)", "word " * 60_000, "w" * 300_000]
    rows = [(i, t, "k", 1, "w", "f") for i, t in enumerate(base * 8)]
    return rows + [(5, "same row here", "k", 1, "w", "f")] * 3 + [(None, "no id here at all", "k", 1, "w", "f")] * 2 + [(None, None, None, None, None, None)]


def test_infill_equals_plain_python(spark):
    rows = odd_texts()
    got = infill.infilled(spark.createDataFrame(rows, TEXTS))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = Counter(filled(r[0], r[1]) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_infill_on_the_given_table(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*f[:5], sha(f[5]), sha(f[6])) for f in (filled(*d) for d in docs))
    assert Counter(tuple(r) for r in infill.op11_infill(spark, SF_SMALL).collect()) == want


# --- 12 ----------------------------------------------------------------------------------------


def all_pairs(rows, similarity=0.9):
    """Per row (vec_id, n_links, component_id, kept) from all pairs."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, float) / max(abs(x) for x in v) if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
    near = [[j for j in range(len(rows)) if j != i and a is not None and unit[j] is not None and len(a) == len(unit[j]) and a @ unit[j] >= similarity] for i, a in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return Counter(out)


def odd_vectors(kind, seed=7):
    rng = np.random.default_rng(seed)
    one = np.float32 if kind == "float" else np.float64
    rows, at = [], 0

    def put(v, times=1):
        nonlocal at
        for _ in range(times):
            rows.append((at, None if v is None else [None if x is None else float(one(x)) for x in v]))
            at += 1

    centres = rng.normal(size=(12, 16))
    for c in centres:
        for _ in range(25):
            put(c + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5]))
    path = np.array([[np.cos(x), np.sin(x), *[0] * 14] for x in np.arange(0, 1.5, 0.2)])  # a chain of links
    for v in path:
        put(v)
    put(centres[0], 40)  # copies, and a multiple of them
    put(centres[0] * 3)
    for v in (None, [], [0] * 16, [None, *[1] * 15], [float("nan"), *[1] * 15], [float("inf"), *[1] * 15], [1e-30] * 16, [1e30] * 16, [1] * 15, [1] * 15):
        put(v, 2)
    rows += [(None, rows[3][1]), (None, [0.0, 1.0, *[0.0] * 14]), (2, rows[60][1]), (2, rows[60][1])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_all_pairs(spark, kind):
    rows = odd_vectors(kind)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, node long, part int")
    want = all_pairs(rows)
    for bytes_ in (vectors.RANGE_BYTES, 2_000):  # few ranges, and so many that they have levels
        assert Counter(tuple(r) for r in vectors.near_vectors(spark, frame, range_bytes=bytes_).collect()) == want


def test_vectors_with_the_leaf_cut_small(spark, monkeypatch):
    rows = odd_vectors("double", 11)
    links = []
    data = [v for _, v in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    monkeypatch.setattr(vectors, "LEAF", 8)
    m = np.array(data)
    for cut in (len(m), 100):
        work = vectors.Joined(m, np.full(len(m), 16), vectors._units(m)[:, :3], np.ones(len(m), int), 0.9)
        work.run(cut)
        links.append(work.links)
    near = vectors._units(m) @ vectors._units(m).T >= 0.9
    np.fill_diagonal(near, False)
    assert (links[0] == near.sum(axis=1)).all()
    near[:100, :100] = near[100:, 100:] = False
    assert (links[1] == near.sum(axis=1)).all()


def test_vectors_on_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(spark, empty).collect() == []
    none = spark.createDataFrame([(1, None, 0), (1, [0.0], 0), (None, None, 0)], "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in vectors.near_vectors(spark, none).collect()) == Counter({(1, 0, 1, True): 2, (None, 0, None, True): 1})


# --- 13 ----------------------------------------------------------------------------------------


def counted(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            words[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    return near


def wanted(docs):
    words = counted(docs)
    near = neighbours(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def odd_words():
    texts = [None, "", "12 34", "colour " * 600, "color " * 100, "collor " * 20, "coller " * 5, "COLOUR Colour", "Àbcdef àbcdef " * 9, "naïvely " * 30 + "naively " * 6, "aabbcc " * 5 + "abbcc " * 50 + "aabbc " * 9 + "aaabbcc " * 40, "x" * 50 + " " + ("x" * 49 + " ") * 6, ("x" * 50 + " ") * 6 + ("x" * 48 + "y ") * 30, ("q" * 4000 + "r" + "q" * 500 + " ") * 6 + ("q" * 4500 + " ") * 31, "straßenbahn ×÷×÷×÷ " * 6, "ssecret_word-here " * 7 + "secrets " * 40, "stream " * 700 + "streem " * 130 + "streen " * 26 + "stieen " * 5, "garden " * 700 + "gardin " * 130 + "gordin " * 26 + "gordan " * 5]
    rows = [(i, t, "k", 1, "w", "f") for i, t in enumerate(texts)]
    rng = np.random.default_rng(3)
    for i in range(300):
        word = "".join(rng.choice(list("abcé"), 6 + i % 3))
        rows.append((1000 + i, f"{word} " * int(rng.integers(1, 60)), "k", 1, "w", "f"))
    return rows + [(3, "repeat repeats", "k", 1, "w", "f")] * 9 + [(None, "without without", "k", 1, "w", "f")] * 5


def test_spelling_equals_plain_python(spark):
    rows = odd_words()
    frame = spark.createDataFrame(rows, TEXTS)
    want = wanted([r[:2] for r in rows])
    assert sum(w[1] is not None and w[1] != w[2] for w in want) >= 2  # paths of several forms
    for most in (spelling.FILTER_WORDS, 60):  # one filter, and several slices
        got = spelling.variants(spark, frame, most=most)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_spelling_probes_in_small_blocks(spark, monkeypatch):
    words = counted([r[:2] for r in odd_words()])
    near = neighbours(words)
    monkeypatch.setattr(spelling, "PROBES", 1000)
    filters = spelling.Filters(Counter(min(len(w), spelling.POOLED) for w in words), 1)
    import pyarrow as pa

    held = np.zeros(filters.total, np.uint64)
    for batch in spelling._set(iter([pa.record_batch([pa.array(list(words))], ["word"])]), filters):
        np.bitwise_or.at(held, batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
    found = set()
    for w in words:
        for _, edits in spelling._edits([w], held, filters, 0):
            found |= {frozenset((w, e)) for e in edits if e in words}
    assert found == {frozenset((w, v)) for w in words for v in near[w]}


def test_spelling_on_the_given_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert sorted(map(tuple, spelling.op13_spelling(spark, SF_SMALL).collect()), key=str) == sorted(wanted(map(tuple, docs.select("doc_id", "text").collect())), key=str)


def test_spelling_on_an_empty_table(spark):
    assert spelling.variants(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_each_pair_is_made_once(spark):
    words = counted([r[:2] for r in odd_words()])
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [frozenset((r["word"], r["other"])) for r in spelling.near_pairs(Scratch(spark, "test"), vocabulary).collect()]
    assert len(got) == len(set(got)) == sum(map(len, neighbours(words).values())) // 2
