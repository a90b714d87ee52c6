"""Odd tables for every operator and pipeline stage, stages against plain Python, workers' memory, and workers elsewhere."""

from __future__ import annotations

import hashlib
import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from spendlens.llm import exactdedup, packing, quality, tokenfiles, toxicity, urls
from spendlens.llm.common import LOWER, UPPER, Scratch, one_text, table
from spendlens.llm.tokens import KEPT, Kept
from tests.llm.test_decontaminate import brute, words
from tests.llm.test_minhash import classes

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, part int, run string, label long, size int, y int, score double"
LONG = "many words of no great sense " * 40_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, 4, 0.5) for i, t in rows], DOCS)


ROWS = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (5, "A b C"), (6, "é 漢字 \U0001f600"), (7, LONG), (8, LONG + "x"), (4, "other text of id four")]


@pytest.fixture(scope="module")
def written(spark):
    """A folder with empty tables, and one with odd rows."""
    import tempfile

    root = tempfile.mkdtemp(prefix="odd-")
    kinds = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int, text string", "benchmark": "item_id long, text string, doc_id long", "pages": "page_id long, url string, html string, host string, label double", "embeddings": "vec_id long, embedding array<float>, label int"}
    rows = {
        "documents": [(i, t, 1, "r", 2, 3, 4, 0.5) for i, t in ROWS], "labels": [(1, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (7, 1, 0, "x"), (4, 1, 0, "x")],
        "benchmark": [(1, "a b c", 1), (None, "a", 1), (2, None, 1)], "pages": [(1, None, "h", "x", 0.5), (None, "x://a.com/", None, "x", 0.5), (2, "x://a.net/fr/" + "y" * 100_000, "h", "x", 0.5), (2, "", "h", "x", 0.5)] * 2,
        "embeddings": [(1, [1.0, 0.0], 1), (1, None, 1), (None, [1.0, 0.1], 1)],
    }
    for name, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/empty/{name}.parquet")
        spark.createDataFrame(rows[name], schema).write.parquet(f"{root}/odd/{name}.parquet")
    return root


def _queries():
    from spendlens.llm import catalog

    return catalog.QUERIES


SIZES = {"op10_urls": ("pages", 8), "op12_vectors": ("embeddings", 3), "op13_spelling": (None, None)}


@pytest.mark.parametrize("key", sorted(_queries()))
def test_empty_tables(spark, written, key):
    assert _queries()[key](spark, f"{written}/empty").collect() == []


@pytest.mark.parametrize("key", sorted(_queries()))
def test_odd_rows_with_clashing_columns(spark, written, key):
    got = _queries()[key](spark, f"{written}/odd").collect()
    _, n = SIZES.get(key, ("documents", len(ROWS)))
    if key == "op8_packing":
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in ROWS)
    elif n is not None:
        assert len(got) == n


def test_pipeline_on_empty_and_odd_tables(spark, written):
    for folder, most in (("empty", 0), ("odd", len(ROWS))):
        docs = table(spark, f"{written}/{folder}", "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, f"{written}/{folder}")
            assert kept.columns == docs.columns and kept.count() <= most
        assert corpus_pipeline.STAGES[-1][1](spark, docs, f"{written}/{folder}").select("doc_id").distinct().count() == (0 if most == 0 else len({r[0] for r in ROWS}))
        # No operator but the first learns; without labels of both kinds it keeps all.
    assert corpus_pipeline.STAGES[0][1](spark, docs_of(spark, ROWS), f"{written}/empty").count() == len(ROWS)


def test_pipeline_leaves_only_its_result(spark):
    from spendlens.session import shared_dir

    held = lambda: {(d, x) for d, _, names in os.walk(f"{shared_dir(spark).removeprefix('file:')}/llm") for x in names if x.endswith(".parquet")}
    before = held()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = held() - before
    assert left and all("best-fit-packing" in d for d, _ in left)
    assert out.count() > 0


def test_stages_keep_what_plain_python_keeps(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = lambda name, given: {r["doc_id"] for r in dict(corpus_pipeline.STAGES)[name](spark, given, SF).select("doc_id").collect()}
    model = quality.learn(docs, table(spark, SF, "labels"))
    assert ids("quality classifier", docs) == {i for i, t in rows.items() if plain_quality(t, model) >= 0.7}
    norm = lambda t: t.translate(str.maketrans(UPPER, LOWER))
    last = {norm(t): i for i, t in sorted(rows.items())}
    assert ids("exact dedup", docs) == set(last.values())
    order = sorted(rows)
    label = classes([rows[i] for i in order])
    first = {}
    for i, c in zip(order, label, strict=True):
        first.setdefault(c if words(rows[i]) else ("alone", i), i)
    assert ids("MinHash near-dedup", docs) == set(first.values())
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert ids("benchmark decontamination", docs) == {r[0] for r in brute(list(rows.items()), items) if not r[5]}


# --- scores from plain Python -------------------------------------------------------------------


def plain_quality(text, model):
    raw, sizes = text.encode(), []
    for d in (model.good, model.bad):
        n = math.ceil(len(raw) / 2000)
        c = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(raw[k * len(raw) // n : (k + 1) * len(raw) // n])) for k in range(n)) or 1)
    z = model.slope * (sizes[1] - sizes[0]) / max(sizes) + model.by_length * math.log10(min(len(raw), 2000) + 10) + model.offset
    return 1 / (1 + math.exp(-z))


def test_quality_scores_and_what_is_lost_by_length(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = quality.learn(docs, labels)
    rows = quality.classify(docs, model).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").select("score", "quality", "text").collect()
    assert all(math.isclose(r["score"], plain_quality(r["text"] or "", model), abs_tol=1e-9) for r in rows)
    lengths = np.array([len(r["text"] or "") for r in rows])
    good, score = np.array([r["quality"] == 1 for r in rows]), np.array([r["score"] for r in rows])
    rank = np.argsort(np.argsort(score))
    auc = (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.93
    for low, high, most in ((0, 200, 0.10), (200, 1000, 0.04), (1000, 5000, 0.03), (5000, 10**9, 0.02)):
        here = good & (lengths >= low) & (lengths < high)
        assert here.sum() > 20 and (score[here] < quality.THRESHOLD).mean() <= most, (low, (score[here] < quality.THRESHOLD).mean())
    assert (score[~good] < quality.THRESHOLD).mean() >= 0.8


def test_toxicity_scores_equal_plain_python(spark):
    """The chain, read from the model: each category's logistic function of the terms and of the categories before."""
    import pyarrow as pa

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.learn(Scratch(spark, "test"), docs, labels)
    place = {int(t): i for i, t in enumerate(model.terms)}
    rows = toxicity.classify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows[:150]:
        _, terms, _, _ = toxicity.terms_of(pa.array([r["text"] or ""]))
        at = sorted({place[int(t)] for t in terms if int(t) in place})
        before = []
        for w in model.weights:
            z = sum(w[i] for i in at) + sum(p * v for p, v in zip(before, w[len(place) :], strict=False)) + w[-1]
            before.append(1 / (1 + math.exp(-z)))
        assert [r[f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(before)
        assert r["toxic"] == (before[-1] >= model.threshold)


def test_urls_by_the_method(spark):
    """Pages whose verdict follows from the site: the method finds it where no rule fits, whatever a hot copy does."""
    rules = [("block", "bad.com/x/"), ("allow", "good.com/x/"), ("block", "worse.org/x/"), ("allow", "fine.org/x/")]
    rows = []
    for i in range(400):
        for host, n in (("bad.com", 9), ("good.com", 2), ("worse.org", 9), ("fine.org", 2)):
            path = "x" if i % 2 else "y"
            rows.append((len(rows), f"http://s{i % 5}.{host}/{path}/{'a1-' * n}{i}?k={i}"))
    rows += [(10_000 + i, "http://good.com/x/hot") for i in range(5000)]
    got = urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string"), rules, sample=300).collect()
    want = lambda host: "block" if host.endswith(("bad.com", "worse.org")) else "allow"
    judged = [r for r in got if r["rule"] is not None]
    rest = [r for r in got if r["rule"] is None]
    assert all(r["verdict"] == want(r["host"]) for r in judged) and len(rest) == 800
    assert sum(r["verdict"] == want(r["host"]) for r in rest) >= 0.99 * len(rest)
    only = spark.createDataFrame([(1, "http://bad.com/x/1"), (2, "http://else.net/"), (3, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(spark, only, rules).collect()} == {"block"}


# --- bounds ---------------------------------------------------------------------------------------


def test_a_repeated_id_stays_one_sampled_row(spark):
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "b"), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["text"] for r in one_text(docs, "doc_id").collect()}
    assert len(one) == 3 and one[1].startswith("text ")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    scratch = Scratch(spark, "test")
    model = toxicity.learn(scratch, docs, labels)
    sampled = spark.read.parquet(f"{scratch.root}/001-sample")
    assert sampled.count() == 3 and 0 < model.threshold < 1
    assert len(tokenfiles.train_dictionary(docs)) < 1000  # three short texts, not 3002


def test_kept_ids_are_bounded_in_bytes():
    kept = Kept(lambda k: k.encode())
    for i in range(200_000):
        kept[f"word-{i}"]
    size = lambda d: sum(len(k) + len(v) for k, v in d.items())
    assert size(kept) + size(kept.older) < 2 * KEPT and kept["again"] == b"again"
    kept["x" * KEPT]
    assert "x" * KEPT not in dict.keys(kept)


MEMORY = """
import resource, sys
import pyarrow as pa
from spendlens.llm import minhash, tokens
text = bytearray()
for i in range(3_300_000):
    text += b"w%d " % (i * 7919 % 1_000_003)
batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text.decode()])], ["a", "b", "c"])
del text
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
rows = [r for b in minhash._sign(iter([batch]), 5, 20, 5) for r in b.to_pylist()]
assert rows[0]["n_words"] == 3_300_000 and batch.nbytes > 20_000_000
print(peak() - before)
"""


def test_memory_of_a_worker_on_a_very_long_text():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, cwd=REPO, check=True, timeout=300)
    assert int(out.stdout) < 420, out.stdout


ELSEWHERE = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for key in sys.argv[2:]:
    print(key, entry.queries()[key](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_that_cannot_find_the_package(tmp_path):
    """Started elsewhere, without PYTHONPATH: the package comes with the job."""
    keys = ["op2_minhash", "op3_tokenfiles", "op5_toxicity", "op7_quality", "op8_packing", "op9_exactdedup", "op12_vectors", "op13_spelling", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE, REPO, *keys], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert [line.split()[0] for line in out.stdout.splitlines() if line.split()[0] in keys] == keys
