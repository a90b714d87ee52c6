from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spendlens.operators import ml, rescale, results, setops, summaries
from spendlens.operators.clean import expense_view


def test_report_never_predicted_class(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")], "actual string, predicted string")
    rep = {r["class"]: r for r in ml.report(pairs).collect()}
    assert (rep["A"].precision, rep["A"].recall, rep["A"].support) == (1.0, 0.5, 2)
    assert math.isclose(rep["A"].f1, 2 / 3)
    assert math.isclose(rep["B"].precision, 1 / 3) and rep["B"].recall == 1.0 and math.isclose(rep["B"].f1, 0.5)
    assert (rep["C"].precision, rep["C"].recall, rep["C"].f1) == (0.0, 0.0, 0.0)
    assert rep["accuracy"].precision == 0.5 and rep["accuracy"].support == 4
    assert math.isclose(rep["macro avg"].recall, 0.5)
    assert math.isclose(rep["weighted avg"].precision, (1.0 * 2 + (1 / 3) * 1 + 0) / 4)


def test_split_exact_and_deterministic(spark):
    rows = [(f"m{i % 7}", "X" if i % 3 else "Y", float(-i - 1)) for i in range(103)] + [("dup", "Y", -1.0)] * 20
    df = spark.createDataFrame(rows, "merchant string, category string, amount double")
    for c in ["date", "description", "profile", "bank", "currency"]:
        df = df.withColumn(c, F.lit("2024-01-01").cast("date") if c == "date" else F.lit("v"))
    s = ml.stratified_split(df)
    counts = {(r.category, r.split): r["count"] for r in s.groupBy("category", "split").count().collect()}
    n_x, n_y = sum(1 for r in rows if r[1] == "X"), sum(1 for r in rows if r[1] == "Y")
    assert counts[("X", "test")] == math.ceil(0.2 * n_x) and counts[("Y", "test")] == math.ceil(0.2 * n_y)
    assert s.count() == len(rows)
    again = ml.stratified_split(df)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "category string")
    w = {r.category: r.weight for r in ml.class_weights(df).collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_tfidf_matches_formula(spark):
    docs = spark.createDataFrame([("red apple pie",), ("red apple",), ("green pie",), ("red apple",)], "text string")
    vocab = {r.term: (r.df, r.idf) for r in ml.tfidf_fit(docs).collect()}
    # n = 4 documents; 'red' and 'apple' in 3, 'pie' in 2, 'red apple' in 3; 'green' only once -> dropped.
    assert set(vocab) == {"red", "apple", "pie", "red apple"}
    assert math.isclose(vocab["pie"][1], math.log(5 / 3) + 1)
    w = {r.term: r.weight for r in ml.tfidf_transform(docs, ml.tfidf_fit(docs)).where("text = 'red apple pie'").collect()}
    assert math.isclose(sum(v * v for v in w.values()), 1.0)


def test_zscore_population(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (5.0,)], "amount double")
    out = ml.zscore(df, ml.scale_stats(df, ["amount"]), ["amount"]).collect()
    std = math.sqrt(((1 - 3.5) ** 2 + (3 - 3.5) ** 2 + 2 * (5 - 3.5) ** 2) / 4)
    assert math.isclose(out[0].amount_z, (1 - 3.5) / std)
    const = spark.createDataFrame([(2.0,), (2.0,)], "amount double")
    assert [r.amount_z for r in ml.zscore(const, ml.scale_stats(const, ["amount"]), ["amount"]).collect()] == [0.0, 0.0]


def test_rescale(spark):
    e = spark.createDataFrame([("p", 2024, -1.0), ("p", 2024, -3.0), ("q", 2024, 0.0)], "profile string, year int, amount double")
    t = spark.createDataFrame([("p", 2024, 10.0), ("q", 2024, 5.0)], "profile string, year int, target double")
    got = sorted((r.profile, r.amount) for r in rescale.rescale_to_target(e, t).collect())
    assert got == [("p", -7.5), ("p", -2.5), ("q", -0.0)]


def test_summaries(spark, txn):
    view = expense_view(txn)
    k = summaries.kpi_dashboard(view).first()
    assert math.isclose(k.total_income - k.total_spent, k.net_cashflow) and k.transaction_count == 10
    months = summaries.cashflow_by_month(view).collect()
    assert math.isclose(sum(r.spending for r in months), k.total_spent)
    empty = summaries.kpi_dashboard(view.where("false")).first()
    assert (empty.total_spent, empty.transaction_count) == (0.0, 0)
    d = summaries.kpi_demo(view).first()
    assert d.spending_over_120pct is False
    with pytest.raises(ValueError):
        summaries.distinct_values(txn, "merchant")
    assert [r.profile for r in summaries.distinct_values(txn, "profile").collect()] == ["Family", "Professional", "Student"]


def test_results_and_setops(spark, txn):
    from spendlens.operators import intents
    from spendlens.operators.filters import Slots

    top = intents.top_categories(txn, Slots())
    roll = results.result_rollup(top, ["-total_spent", "category"], "category").first()
    assert (roll.rows, roll.first_key) == (3, "Groceries")
    assert results.result_zero_like(top).first().zero_like is False
    assert results.result_zero_like(top.where("false")).first().zero_like is True
    assert results.result_zero_like(top.select("category")).first().zero_like is False
    assert [r.category for r in setops.taxonomy_unexpected(txn).collect()] == []
    assert "Housing" in [r.category for r in setops.taxonomy_missing(txn).collect()]
    assert setops.profile_coverage(txn).first().all_present is True


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_exact_quantiles_over_ranges(spark, ranges):
    import numpy as np

    from spendlens.operators import describe

    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 100, 500).round(2), np.full(300, 5.0), rng.exponential(1000, 200).round(2)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "amount double")
    pairs = describe.sorted_counts(df, "amount", ranges)
    assert pairs.agg(F.sum("c")).first()[0] == len(vals)
    got = {r.p: r.value for r in describe.exact_quantiles(pairs, [0.25, 0.5, 0.75, 0.0, 1.0]).collect()}
    assert set(got) == {0.25, 0.5, 0.75, 0.0, 1.0}
    for p, v in got.items():
        assert math.isclose(v, float(np.percentile(vals, p * 100)), rel_tol=1e-12, abs_tol=1e-9), p


def test_describe_odd_tables(spark):
    from spendlens.operators import describe

    df = spark.createDataFrame([(None, None)] * 3, "amount double, merchant string")
    rows = {r["column"]: r for r in describe.describe_all(df, ("amount",), ("merchant",)).collect()}
    assert (rows["amount"]["count"], rows["amount"].q50, rows["merchant"]["count"], rows["merchant"].unique, rows["merchant"].top) == (0, None, 0, 0, None)
    df = spark.createDataFrame([(2.0, "b"), (4.0, "a"), (None, None)], "amount double, merchant string")
    rows = {r["column"]: r for r in describe.describe_all(df, ("amount",), ("merchant",)).collect()}
    assert (rows["amount"].q25, rows["amount"].q50, rows["merchant"].top, rows["merchant"].freq, rows["merchant"].unique) == (2.5, 3.0, "a", 1, 2)


def test_split_of_odd_rows(spark):
    """Copies beyond the boundary, amounts beyond the decimal, one hot row, null labels, and labels too rare to part."""
    schema = "merchant string, category string, amount double, extra int"
    rows = [("m", "X", -1e17, 0), ("m", "X", 1e300, 0)] + [("hot", "X", -1.0, i % 3) for i in range(500)] + [(f"n{i}", None, float(i), i) for i in range(11)]

    def full(r):
        df = spark.createDataFrame(r, schema)
        for c in ["date", "description", "profile", "bank", "currency"]:
            df = df.withColumn(c, F.lit("2024-01-01").cast("date") if c == "date" else F.lit("v"))
        return df

    for given in (rows, rows[:2], rows[2:], rows + [("one", "rare", 1.0, 1)]):
        df = full(given)
        got = ml.stratified_split(df)
        assert got.drop("row_key", "split").exceptAll(df).isEmpty() and got.count() == len(given)
        by_label = len(given) != len(rows) + 1
        sizes = {}
        for r in got.collect():
            n = sizes.setdefault(r.category if by_label else "*", [0, 0])
            n[r.split == "test"] += 1
        for train, test in sizes.values():
            assert test == math.ceil(0.2 * (train + test))


def test_split_moves_no_rows(spark):
    """The rows are compared where they are: no exchange but of the boundary's broadcast."""
    from spendlens.plans.catalog import txn

    rows = txn(spark, "/root/testdata/sf0.001")
    split = ml.split_bounds(rows)
    assert not split.shared
    plan = split.apply(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_tfidf_with_frequent_terms_apart(spark, monkeypatch):
    """A vocabulary beyond the broadcast's bound: frequent terms by broadcast, the others by shuffle, the same weights."""
    texts = [(f"common w{i} w{i % 7} shop {'x y zz ' * (i % 3)}",) for i in range(60)] + [("common",), ("",), ("rare1 rare1 rare2",)]
    docs = spark.createDataFrame(texts * 2, "text string")
    vocab = ml.tfidf_fit(docs)
    want = {(r.text, r.term): r.weight for r in ml.tfidf_transform(docs, vocab).collect()}
    monkeypatch.setattr(ml, "is_small", lambda df: False)
    got = {(r.text, r.term): r.weight for r in ml.tfidf_transform(docs, vocab, frequent=0.5).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)
    plan = ml.tfidf_transform(docs, vocab, frequent=0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_vectors_from_terms(spark):
    docs = spark.createDataFrame([("red apple pie",), ("red apple",), ("green pie",), ("red apple",), ("??",)], "text string")
    vocab = ml.indexed(ml.tfidf_fit(docs))
    place = {r.term: r["index"] for r in vocab.collect()}
    assert place == {t: i for i, t in enumerate(sorted(place))}
    weights = {(r.text, place[r.term]): r.weight for r in ml.tfidf_transform(docs, vocab).collect()}
    rows = ml.tfidf_vectors(docs, vocab).collect()
    assert {(r.text, i): v for r in rows for i, v in zip(r["indices"], r["values"], strict=True)} == pytest.approx(weights)
    vector = ml.tfidf_vectors(docs, vocab).where("text = 'green pie'").select(ml.sparse_vector(F.col("indices"), F.col("values"), 4).alias("v")).first().v
    assert vector.size == 4 and list(vector.indices) == [place["pie"]] and vector.values[0] == 1.0


def test_model_package(spark, tmp_path, txn):
    rows = txn.unionByName(txn.withColumn("amount", F.col("amount") - 1)).unionByName(txn.withColumn("amount", F.col("amount") - 2))
    model, predicted = ml.train_model(rows, num_trees=5, max_depth=4)
    assert predicted.count() == sum(math.ceil(0.2 * r["count"]) for r in rows.groupBy("category").count().collect())
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    loaded = ml.load_model(spark, path)
    assert (loaded.terms, loaded.labels) == (model.terms, sorted(r.category for r in rows.select("category").distinct().collect()))
    assert sorted(map(tuple, loaded.report.collect())) == sorted(map(tuple, model.report.collect()))
    columns = [*rows.columns, "predicted_category"]
    assert sorted(map(tuple, ml.predict(loaded, rows).select(*columns).collect())) == sorted(map(tuple, ml.predict(model, rows).select(*columns).collect()))
    raw = rows.withColumn("amount", F.col("amount").cast("string")).withColumn("date", F.col("date").cast("string")).unionByName(
        rows.limit(1).withColumn("amount", F.lit("oops")).withColumn("date", F.lit("never"))).withColumn("merchant", F.concat(F.lit("  "), "merchant"))
    again = ml.recategorize(spark, raw, path)  # cleans first
    assert again.count() == rows.count() and again.columns == rows.columns and {r.category for r in again.collect()} <= set(loaded.labels)
    assert ml.recategorize(spark, raw, str(tmp_path / "none")).count() == rows.count()
    import json

    file = tmp_path / "model" / "package.json"
    file.unlink()
    (tmp_path / "model" / ".package.json.crc").unlink(missing_ok=True)
    assert ml.load_model(spark, path) is None  # not whole
    file.write_text(json.dumps({"version": 0}))
    with pytest.raises(ValueError, match="other features"):
        ml.load_model(spark, path)


def test_forest_beats_majority_class(spark):
    from spendlens.plans.catalog import txn

    t = txn(spark, "/root/testdata/sf0.001")
    model, preds = ml.train_model(t, num_trees=10, max_depth=8)
    assert model.terms == model.vocabulary.count() > 200
    rows = preds.select("category", "predicted_category").collect()
    assert len(rows) > 0 and all(r.predicted_category is not None for r in rows)
    acc = sum(r.category == r.predicted_category for r in rows) / len(rows)
    counts = {}
    for r in rows:
        counts[r.category] = counts.get(r.category, 0) + 1
    assert acc >= max(counts.values()) / len(rows)
    out = ml.predict(model, t.limit(5))
    assert out.columns[-1] == "predicted_category" and out.count() == 5


def test_copies_at_the_boundary_are_kept_from_the_search(spark):
    """The rows around the boundary are stored when it is looked for, so their copies cost no second pass; the same parts."""
    df = spark.range(600).selectExpr("date'2024-01-01' as date", "cast(id % 3 as string) as merchant", "'v' as description", "cast(-1 as double) as amount",
                                     "if(id % 5 = 0, null, 'X') as category", "'v' as profile", "'v' as bank", "'v' as currency")
    split = ml.split_bounds(df)
    assert split.shared == 2
    got = split.apply(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    other = ml.Split(split.label, split.by_label, split.bounds).apply(df)
    assert got.columns == other.columns and got.exceptAll(other).isEmpty() and other.exceptAll(got).isEmpty() and got.count() == 600
    assert {(r.category, r.n) for r in got.where("split = 'test'").groupBy("category").agg(F.count("*").alias("n")).collect()} == {(None, 24), ("X", 96)}
    more = df.union(df)  # of other rows than it was fitted on, none is left out
    assert split.apply(more).count() == 1200
