"""ML and rescale queries over the stored transaction table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spendlens.functions.money import exact_sum
from spendlens.operators import clean, ml, rescale
from spendlens.plans.catalog import RAW_HEADERS, register, txn
from spendlens.sources import table as tbl
from spendlens.sources.binding import DRIVER_TABLES, table_path

# Float outputs that go through ln / sqrt / float sums are rounded for the comparison:
# tf-idf weights to 6 decimals (the engines agree to a few ulps), z-scores to 4 (mean
# and std are float aggregates whose summation order differs, ~1e-12 apart).

# The forest has the reference's 250 trees, of limited depth; ml_train grows them in every run, the other keys share a stored one.
NUM_TREES, MAX_DEPTH = 250, 6

KEYED = (
    "k AS (SELECT *, md5(concat_ws('|', CAST(date AS VARCHAR), merchant, description, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR),"
    " category, profile, bank, currency)) AS row_key FROM transactions),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_key) AS rn,"
    " COUNT(*) OVER (PARTITION BY category) AS n FROM k)"
)
TRAIN = "tr AS (SELECT * FROM r WHERE rn > CEIL(n * 0.2))"
FEATURES = (
    "f AS (SELECT amount, ABS(amount) AS abs_amount, month(date) AS month, isodow(date) - 1 AS day_of_week,"
    " CAST(amount > 0 AS INTEGER) AS is_income, merchant || ' ' || description || ' ' || profile || ' ' || bank AS text FROM transactions)"
)
TRAIN_FEATURES = FEATURES.replace("f AS", "ft AS", 1).replace("FROM transactions", "FROM tr")


def train_part(spark, sf_dir):
    """(the split's bounds, the training rows)."""
    split = ml.split_bounds(txn(spark, sf_dir))
    return split, split.apply(txn(spark, sf_dir)).where("split = 'train'")


@register(
    "ml_label_index",
    "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS label_index FROM (SELECT DISTINCT category FROM transactions)",
)
def q_ml_label_index(spark, sf_dir):
    return ml.label_index(txn(spark, sf_dir))


@register(
    "ml_split",
    f"WITH {KEYED} SELECT category, CASE WHEN rn <= CEIL(n * 0.2) THEN 'test' ELSE 'train' END AS split, COUNT(*) AS rows,"
    " CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount_total FROM r GROUP BY 1, 2",
)
def q_ml_split(spark, sf_dir):
    s = ml.stratified_split(txn(spark, sf_dir))
    return s.groupBy("category", "split").agg(F.count(F.lit(1)).alias("rows"), exact_sum("amount").alias("amount_total"))


@register(
    "ml_class_weight",
    f"WITH {KEYED}, c AS (SELECT category, COUNT(*) AS n_c FROM r WHERE rn > CEIL(n * 0.2) GROUP BY 1)"
    " SELECT category, (SELECT SUM(n_c) FROM c) / ((SELECT COUNT(*) FROM c) * n_c) AS weight FROM c",
)
def q_ml_class_weight(spark, sf_dir):
    return ml.class_weights(train_part(spark, sf_dir)[1])


_TFIDF = (
    f"{KEYED}, {TRAIN}, {FEATURES}, {TRAIN_FEATURES}, t AS (SELECT DISTINCT text FROM f),"
    " tt AS (SELECT text, COUNT(*) AS mult FROM ft GROUP BY text),"
    " tk AS (SELECT text, regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}') AS toks FROM t),"
    " tm AS (SELECT text, list_concat(toks, CASE WHEN len(toks) > 1 THEN"
    " list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS terms FROM tk),"
    " v AS (SELECT term, SUM(mult) AS df FROM (SELECT text, unnest(list_distinct(terms)) AS term FROM tm) JOIN tt USING (text) GROUP BY term HAVING SUM(mult) >= 2),"
    " nd AS (SELECT SUM(mult) AS n FROM tt),"
    " tf AS (SELECT text, term, COUNT(*) AS tf FROM (SELECT text, unnest(terms) AS term FROM tm) GROUP BY 1, 2),"
    " w AS (SELECT tf.text, tf.term, tf.tf * (ln((1 + nd.n) / (1 + v.df)) + 1) AS raw FROM tf JOIN v USING (term), nd),"
    " nrm AS (SELECT text, sqrt(SUM(raw * raw)) AS norm FROM w GROUP BY text)"
)


@register("ml_tfidf", f"WITH {_TFIDF} SELECT w.text, w.term, round(w.raw / nrm.norm, 6) AS weight FROM w JOIN nrm USING (text)")
def q_ml_tfidf(spark, sf_dir):
    vocab, docs = _vocabulary(spark, sf_dir)
    return ml.tfidf_transform(docs, vocab).withColumn("weight", F.round("weight", 6))


def _vocabulary(spark, sf_dir):
    """(terms of the training part with idf, stored; the texts of all rows)."""
    split, train = train_part(spark, sf_dir)
    vocab = ml.tfidf_fit(clean.feature_view(train).select("text"), n_docs=split.n_train)
    return tbl.written(vocab, "vocabulary"), clean.feature_view(txn(spark, sf_dir)).select("text")


@register(
    "ml_vectors",
    f"WITH {_TFIDF}, ix AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM v)"
    " SELECT w.text, CAST(string_agg(CAST(ix.index AS VARCHAR) || ':' || printf('%.6f', w.raw / nrm.norm), ' ' ORDER BY ix.index) AS VARCHAR) AS vector"
    " FROM w JOIN nrm USING (text) JOIN ix USING (term) GROUP BY w.text",
)
def q_ml_vectors(spark, sf_dir):
    vocab, docs = _vocabulary(spark, sf_dir)
    rows = ml.tfidf_vectors(docs, ml.indexed(vocab))
    shown = F.zip_with("indices", "values", lambda i, v: F.format_string("%d:%.6f", i, v))
    return rows.select("text", F.array_join(shown, " ").alias("vector"))


_Z = ", ".join(
    f"round(({c} - avg_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END, 4) + 0.0 AS {c}_z" for c in ml.NUMERIC_FEATURES
)
_S = ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS sd_{c}" for c in ml.NUMERIC_FEATURES)


@register("ml_scale", f"WITH {KEYED}, {TRAIN}, {FEATURES}, {TRAIN_FEATURES}, s AS (SELECT {_S} FROM ft) SELECT {_Z} FROM f, s")
def q_ml_scale(spark, sf_dir):
    stats = ml.scale_stats(clean.feature_view(train_part(spark, sf_dir)[1]))
    out = ml.zscore(clean.feature_view(txn(spark, sf_dir)), stats)
    # "+ 0.0" turns a rounded -0.0 into 0.0 on both sides.
    return out.select(*[(F.round(f"{c}_z", 4) + F.lit(0.0)).alias(f"{c}_z") for c in ml.NUMERIC_FEATURES])


_ENC = (
    "enc AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS index FROM"
    " (SELECT 'profile' AS feature, profile AS value FROM tr UNION SELECT 'bank', bank FROM tr UNION SELECT 'currency', currency FROM tr))"
)


@register("ml_onehot_values", f"WITH {KEYED}, {TRAIN}, {_ENC} SELECT feature, value, index FROM enc")
def q_ml_onehot_values(spark, sf_dir):
    return ml.encoder_vocab(train_part(spark, sf_dir)[1])


@register(
    "ml_onehot",
    f"WITH {KEYED}, {TRAIN}, {_ENC} SELECT t.profile, t.bank, t.currency, " + ", ".join(f"e{i}.index AS {c}_index" for i, c in enumerate(ml.CATEGORICAL_FEATURES))
    + " FROM transactions t" + "".join(f" LEFT JOIN enc e{i} ON e{i}.feature = '{c}' AND e{i}.value = t.{c}" for i, c in enumerate(ml.CATEGORICAL_FEATURES)),
)
def q_ml_onehot(spark, sf_dir):
    """Every row's place of the one in each encoded feature (NULL: a value unseen in training, all zeros)."""
    vocab = tbl.written(ml.encoder_vocab(train_part(spark, sf_dir)[1]), "encoders")
    rows = ml.one_hot(txn(spark, sf_dir), vocab)
    return rows.select(*ml.CATEGORICAL_FEATURES, *[f"{c}_index" for c in ml.CATEGORICAL_FEATURES])


@register(
    "rescale_to_target",
    "WITH e AS (SELECT profile, CAST(year(date) AS INTEGER) AS year, date, merchant, description, category, bank, currency, amount"
    " FROM transactions WHERE amount < 0),"
    " tg AS (SELECT profile, CAST(year(date) AS INTEGER) AS year, SUM(CAST(amount AS DECIMAL(18,4))) AS target FROM transactions"
    " WHERE amount > 0 GROUP BY 1, 2),"
    " c AS (SELECT profile, year, SUM(CAST(ABS(amount) AS DECIMAL(18,4))) AS cur FROM e GROUP BY 1, 2),"
    " f AS (SELECT c.profile, c.year, CAST(CAST(tg.target AS DECIMAL(38,4)) * 10000 AS HUGEINT) AS t_u,"
    " CAST(CAST(CASE WHEN cur = 0 THEN 1 ELSE cur END AS DECIMAL(38,4)) * 10000 AS HUGEINT) AS c_u FROM c JOIN tg USING (profile, year))"
    " SELECT e.profile, e.year, e.date, e.merchant, e.description, e.category, e.bank, e.currency,"
    " -(CAST((CAST(CAST(ABS(e.amount) AS DECIMAL(38,4)) * 10000 AS HUGEINT) * f.t_u * 2 + f.c_u * 100) // (f.c_u * 200) AS DOUBLE) / 100)"
    " AS amount FROM e JOIN f USING (profile, year)",
)
def q_rescale_to_target(spark, sf_dir):
    t = txn(spark, sf_dir).withColumn("year", F.year("date"))
    expenses = t.where(F.col("amount") < 0)
    targets = t.where(F.col("amount") > 0).groupBy("profile", "year").agg(
        F.sum(F.col("amount").cast("decimal(18,4)")).alias("target")
    )
    out = rescale.rescale_to_target(expenses, targets)
    return out.select("profile", "year", "date", "merchant", "description", "category", "bank", "currency", "amount")


# --- the forest ----------------------------------------------------------------------------------------


def _model_dir(spark: SparkSession, sf_dir: str) -> str:
    fp = tbl.fingerprint(spark, [table_path(sf_dir, t) for t in DRIVER_TABLES])
    return f"{tbl.tables_root(spark)}/model-v{ml.VERSION}-{fp}-t{NUM_TREES}d{MAX_DEPTH}"


def trained(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the model of these inputs, trained once."""
    root = _model_dir(spark, sf_dir)
    if ml.load_model(spark, root) is None:
        ml.save_model(ml.train_model(txn(spark, sf_dir), num_trees=NUM_TREES, max_depth=MAX_DEPTH)[0], root)
    return root


def _model(spark, sf_dir) -> ml.Model:
    return ml.load_model(spark, trained(spark, sf_dir))


def _test_part(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return ml.split_bounds(rows).apply(rows).where("split = 'test'").drop("split", "row_key")


#: Classes, rows and column names of the report don't depend on the forest; its figures do.
@register("ml_train", None)
def q_ml_train(spark, sf_dir):
    """Trains in the run and reports on the test part."""
    return ml.train_model(txn(spark, sf_dir), num_trees=NUM_TREES, max_depth=MAX_DEPTH)[0].report


@register(
    "ml_report",
    f"WITH {KEYED}, c AS (SELECT category, COUNT(*) AS support FROM r WHERE rn <= CEIL(n * 0.2) GROUP BY 1)"
    " SELECT category AS class, CAST(support AS BIGINT) AS support, true AS agrees FROM c"
    " UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), CAST((SELECT SUM(support) FROM c) AS BIGINT), true",
)
def q_ml_report(spark, sf_dir):
    """Scores the test part in the run; ``agrees`` where the figures are those saved with the model."""
    model = _model(spark, sf_dir)
    scored = ml.predict(model, _test_part(spark, sf_dir)).select("category", "predicted_category")
    now = ml.report(tbl.written(scored, "scored"), "category", "predicted_category")  # which reads them several times
    saved = model.report.select(F.col("class"), *[F.col(c).alias(f"saved_{c}") for c in ("precision", "recall", "f1", "support")])
    same = F.col("support") == F.col("saved_support")
    for c in ("precision", "recall", "f1"):
        same = same & (F.abs(F.col(c) - F.col(f"saved_{c}")) < 1e-9)
    return now.join(saved, "class", "left").select("class", "support", F.coalesce(same, F.lit(False)).alias("agrees"))


_ROW = "date, merchant, description, amount"


@register("ml_predict", f"WITH {KEYED} SELECT {_ROW}, category, true AS known FROM r WHERE rn <= CEIL(n * 0.2)")
def q_ml_predict(spark, sf_dir):
    """The test part, scored; ``known`` where the prediction is a label of the training part."""
    model = _model(spark, sf_dir)
    rows = ml.predict(model, _test_part(spark, sf_dir))
    return rows.select("date", "merchant", "description", "amount", "category", F.coalesce(F.col("predicted_category").isin(model.labels), F.lit(False)).alias("known"))


@register("ml_assemble", None)
def q_ml_assemble(spark, sf_dir):
    model = _model(spark, sf_dir)
    return model.pipeline.transform(model.features(txn(spark, sf_dir), [*ml.NUMERIC_FEATURES, *ml.CATEGORICAL_FEATURES])).select("features")


@register("ml_recategorize", "SELECT date, merchant, description, amount, profile, bank, currency, true AS known FROM transactions")
def q_ml_recategorize(spark, sf_dir):
    """Raw text rows, cleaned and with predicted categories."""
    root = trained(spark, sf_dir)
    raw = clean.raw_text_view(txn(spark, sf_dir), RAW_HEADERS).withColumn("Spare Column", F.lit("x"))
    labels = ml.load_model(spark, root).labels
    out = ml.recategorize(spark, raw, root)
    return out.select("date", "merchant", "description", "amount", "profile", "bank", "currency", F.coalesce(F.col("category").isin(labels), F.lit(False)).alias("known"))


@register("ml_save", "SELECT category, COUNT(*) AS rows FROM transactions GROUP BY 1")
def q_ml_save(spark, sf_dir):
    """The package saved anew; the table scored by it, counted by true category."""
    root = trained(spark, sf_dir)
    ml.save_model(ml.load_model(spark, root), f"{root}/saved")
    scored = ml.predict(ml.load_model(spark, f"{root}/saved"), txn(spark, sf_dir))
    return scored.where(F.col("predicted_category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


@register("ml_load", None)
def q_ml_load(spark, sf_dir):
    return ml.predict(_model(spark, sf_dir), txn(spark, sf_dir))


@register("ml_save_load", "SELECT COUNT(*) AS rows, COUNT(*) AS same FROM transactions")
def q_ml_save_load(spark, sf_dir):
    root = trained(spark, sf_dir)
    model = ml.load_model(spark, root)
    ml.save_model(model, f"{root}/copy")
    first = ml.predict(model, txn(spark, sf_dir)).withColumnRenamed("predicted_category", "before")
    both = ml.predict(ml.load_model(spark, f"{root}/copy"), first)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") == F.col("predicted_category")).alias("same"))
