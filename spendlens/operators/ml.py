"""Category classifier: relational feature parts and a pyspark.ml pipeline.

Relational parts (each checked against DuckDB):

* ``row_keys`` - md5 of the bound columns; identical rows share a key.
* ``stratified_split`` - exact 80/20 split per label: the test part of a
  label is its ceil(0.2 * n) rows with the smallest keys. Only each label's
  boundary is looked for (``split_bounds``), by counts; rows are compared with
  it where they are. A label holding a third of the rows is never one task.
* ``tfidf`` - word 1-2-grams, terms in >= 2 fitting documents, sklearn's
  smooth idf ln((1+n)/(1+df)) + 1, l2 norm. Documents are deduplicated by
  text first (a multiplicity column), so repeated texts cost one row.
* ``zscore`` (population std, zero std -> 1), ``encoder_vocab`` (sorted
  categories -> index), ``class_weights`` (n / (k * n_c)), ``report``.

The forest (``operators.forest``) grows on sparse vectors built from the
relational tf-idf by ``pyspark.ml`` stages; its trees differ from sklearn's, so
its predictions are checked by their report.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import sizes
from spendlens.functions.sizes import small
from spendlens.operators import forest as trees
from spendlens.operators.clean import feature_view, normalize

# The model's feature lists, as in the reference.
TEXT_FEATURE = "text"
NUMERIC_FEATURES = ["amount", "abs_amount", "month", "day_of_week", "is_income"]
CATEGORICAL_FEATURES = ["profile", "bank", "currency"]
KEY_COLUMNS = ["date", "merchant", "description", "amount", "category", "profile", "bank", "currency"]
TOKEN = r"[\pL\pN_]{2,}"
HEX = 3  # hex digits of the key in each counting round of the split
BLOCK = 1_000_000  # copies of a row that are numbered together
PASSED = 10_000  # rows that a task gives back together
LOOKUP_TERMS = 4_000_000  # terms (some 30 bytes each) that every task may hold to look up those of its rows; more are joined
FREQUENT = 0.001  # of the most frequent term's documents: terms from there on are joined by broadcast


def row_keys(df: DataFrame) -> DataFrame:
    parts = []
    for c in KEY_COLUMNS:
        v = F.col(c).cast("string")
        if c == "amount":  # to the cent where the type holds it
            v = F.coalesce(F.col(c).try_cast("decimal(18,2)").cast("string"), v)
        parts.append(F.coalesce(v, F.lit("")))
    return df.withColumn("row_key", F.md5(F.concat_ws("|", *parts)))


# --- split -----------------------------------------------------------------------------------


class Split:
    """An exact split per label, known by one boundary row per label: ``bounds`` has the last key of the test part and how
    many of its ``copies`` belong there (``taken``), beside the label's rows ``n`` and test rows ``t``. A row's part is a
    comparison with its label's boundary, so the rows themselves are never shuffled or stored."""

    def __init__(self, label: str, by_label: bool, bounds: DataFrame, fitted: DataFrame | None = None, near: DataFrame | None = None):
        """``near``: the rows of ``fitted`` around the boundaries, each different one with its number of copies ``cnt``."""
        self.label, self.by_label, self.bounds, self.fitted, self.near = label, by_label, bounds, fitted, near
        facts = bounds.agg(F.coalesce(F.sum(F.col("n") - F.col("t")), F.lit(0)), F.count_if(F.col("taken") < F.col("copies"))).first()
        self.n_train, self.shared = int(facts[0]), int(facts[1])

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with row_key and split."""
        keyed = row_keys(df)
        own = self.bounds.select("_g", *[F.col(c).alias(f"_{c}") for c in ("key", "taken", "copies")])
        rows = keyed.withColumn("_g", _group(self.label, self.by_label)).join(small(own), "_g", "left")
        shared = F.coalesce((F.col("row_key") == F.col("_key")) & (F.col("_taken") < F.col("_copies")), F.lit(False))
        side = F.when(F.col("row_key") <= F.col("_key"), "test").otherwise("train")  # of a label that had no rows: train
        out = rows.where(~shared).select(*keyed.columns, side.alias("split")) if self.shared else rows.select(*keyed.columns, side.alias("split"))
        if not self.shared:
            return out
        # The copies of a boundary key belong to both parts: each different row with its number of copies, numbered.
        if self.near is not None and df.sameSemantics(self.fitted):  # stored when the boundary was looked for
            same = self.near.join(small(own), "_g").where(shared).select(*keyed.columns, "_g", "_taken", F.col("cnt").alias("_c"))
        else:
            same = rows.where(shared).groupBy(*keyed.columns, "_g", "_taken").agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy("_g").orderBy(*keyed.columns).rowsBetween(Window.unboundedPreceding, -1)
        same = same.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        same = same.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / BLOCK))))
        last = F.least(F.col("_c"), (F.col("_block") + 1) * BLOCK)
        same = same.withColumn("_copy", F.explode(F.sequence(F.col("_block") * BLOCK + 1, last)))
        side = F.when(F.col("_before") + F.col("_copy") <= F.col("_taken"), "test").otherwise("train")
        return out.unionByName(same.select(*keyed.columns, side.alias("split")))


def _group(label: str, by_label: bool) -> Column:
    return F.concat(F.lit("="), F.coalesce(F.col(label).cast("string"), F.lit(""))) if by_label else F.lit("*")


def _boundary(counts: DataFrame, part: str, carry: list[str]) -> DataFrame:
    """Per group the first ``part`` (in order) at which the running count reaches ``t``: _g, carry, part, before, cnt."""
    order = Window.partitionBy("_g").orderBy(part)
    run = counts.withColumn("upto", F.col("before") + F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = run.where(F.col("upto") >= F.col("t")).groupBy("_g", *carry).agg(F.min_by(F.struct(part, "cnt", "upto"), F.col(part)).alias("b"))
    return at.select("_g", *carry, F.col(f"b.{part}").alias(part), (F.col("b.upto") - F.col("b.cnt")).alias("before"), F.col("b.cnt").alias("cnt"))


def split_bounds(df: DataFrame, label: str = "category", test_fraction: float = 0.2) -> Split:
    """The boundary of each label, found without moving rows: one pass counts rows by HEX hex digits of their key (partial
    aggregates; at most 16 ** HEX rows a label), a second one stores the rows of the part that holds the boundary, about one
    in 16 ** HEX of a label, equal rows counted together. There the next digits are counted, and what is left then is ranked."""
    from spendlens.sources.table import written

    keyed = row_keys(df)
    digits = lambda k: F.substring("row_key", HEX * k + 1, HEX)
    counts = written(keyed.groupBy(_group(label, True).alias("_g"), digits(0).alias("p0")).agg(F.count(F.lit(1)).alias("cnt")), "split-counts")
    least = counts.groupBy("_g").agg(F.sum("cnt").alias("n")).agg(F.min("n")).first()[0]
    by_label = least is not None and least >= 2  # else no label can be kept apart
    if not by_label:
        counts = counts.groupBy(F.lit("*").alias("_g"), "p0").agg(F.sum("cnt").alias("cnt"))
    sizes = Window.partitionBy("_g")
    counts = counts.withColumn("n", F.sum("cnt").over(sizes)).withColumn("t", F.ceil(F.col("n") * F.lit(Decimal(str(test_fraction)))).cast("bigint"))
    facts = ["n", "t"]
    at = _boundary(counts.withColumn("before", F.lit(0).cast("bigint")), "p0", facts)
    # Of a plain table the rows of the part are stored whole, for the copies of a boundary row.
    whole = KEY_COLUMNS if sorted(df.columns) == sorted(KEY_COLUMNS) else []
    keyed = keyed.select(_group(label, by_label).alias("_g"), "row_key", digits(0).alias("p0"), *whole)
    own = keyed.join(small(at.select("_g", "p0", "before", *facts)), ["_g", "p0"]).groupBy("_g", "row_key", "before", *facts, *whole).agg(F.count(F.lit(1)).alias("cnt"))
    near = own = written(own.withColumn("p1", digits(1)), "split-keys")
    if whole:
        own = near.groupBy("_g", "row_key", "before", *facts, "p1").agg(F.sum("cnt").alias("cnt"))
    inner = own.groupBy("_g", "p1", "before", *facts).agg(F.sum("cnt").alias("cnt"))
    at = written(_boundary(inner, "p1", facts), "split-parts")
    last = own.drop("before", *facts).join(small(at.select("_g", "p1", "before", *facts)), ["_g", "p1"])
    at = _boundary(last, "row_key", facts)
    bounds = at.select("_g", F.col("row_key").alias("key"), (F.col("t") - F.col("before")).alias("taken"), F.col("cnt").alias("copies"), *facts)
    return Split(label, by_label, written(bounds, "split-bounds"), df, near if whole else None)


def stratified_split(df: DataFrame, label: str = "category", test_fraction: float = 0.2) -> DataFrame:
    """Adds ``row_key`` and ``split`` in ('train', 'test'); stratified when every label has >= 2 rows."""
    return split_bounds(df, label, test_fraction).apply(df)


# --- tf-idf (relational) --------------------------------------------------------------------------


def is_small(vocab: DataFrame) -> bool:
    """Whether each task may hold it."""
    return sizes.is_small(vocab, LOOKUP_TERMS)


def with_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_toks``: the words of the lower-cased text."""
    return docs.withColumn("_toks", F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 0))


def with_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``terms``: word 1-grams then 2-grams of the lower-cased text."""
    toks = with_tokens(docs, text_col)
    t = F.col("_toks")
    bigrams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))),
        lambda i: F.concat(F.element_at(t, i), F.lit(" "), F.element_at(t, i + 1)),
    )
    terms = F.concat(t, F.when(F.size(t) > 1, bigrams).otherwise(F.array().cast("array<string>")))
    return toks.withColumn("terms", terms).drop("_toks")


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Each distinct text with its number of documents."""
    return docs.groupBy(text_col).agg(F.count(F.lit(1)).alias("mult"))


def tfidf_fit(docs: DataFrame, text_col: str = "text", min_df: int = 2, n_docs: int | None = None) -> DataFrame:
    """Vocabulary with idf: (term, df, idf) over the fitting documents; ``n_docs`` spares the count where it is known."""
    texts = with_terms(_distinct_texts(docs, text_col), text_col)
    n_docs = docs.count() if n_docs is None else n_docs
    df_terms = (
        texts.select("mult", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.sum("mult").alias("df"))
        .where(F.col("df") >= min_df)
    )
    return df_terms.select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def indexed(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``index``: the place of each term in sorted order, from 0.

    A range sort puts the terms in order over many tasks; a term's place is its number in its range after the terms of
    the ranges before (one row per range). The vocabulary is never in one place.
    """
    from spendlens.sources.table import written

    names = vocab.columns
    rows = vocab.repartitionByRange("term").sortWithinPartitions("term")
    rows = written(rows.select(*names, F.monotonically_increasing_id().alias("_id"), F.spark_partition_id().alias("_part")), "terms")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(small(before), "_part").select(*names, (F.col("_id") - F.col("_first") + F.col("_before")).alias("index"))


def _term_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(text, term, tf)."""
    counted = F.transform(
        F.array_distinct("terms"),
        lambda x: F.struct(x.alias("term"), F.size(F.filter("terms", lambda y: y == x)).alias("tf")),
    )
    return texts.select(text_col, F.explode(counted).alias("p")).select(text_col, "p.term", "p.tf")


def _lookup(vocab: DataFrame) -> Callable[[pa.ListArray], tuple[pa.Array, tuple[pa.ListArray, pa.ListArray]]]:
    """What gives, for the words of some texts, the vocabulary's terms and, for each text, the places of its own among them with
    their l2-normalised weights. At most LOOKUP_TERMS terms; a term's place is its ``index`` where it has one."""
    held = (vocab.select("term", "idf").orderBy("index") if "index" in vocab.columns else vocab.select("term", "idf")).toArrow()
    terms, idf = held["term"].combine_chunks(), np.asarray(held["idf"])

    def items(tokens: pa.ListArray) -> tuple[pa.Array, tuple[pa.ListArray, pa.ListArray]]:
        n, size = len(tokens), max(len(terms), 1)
        row = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
        words = tokens.flatten()
        known = terms.cast(words.type)
        pairs = pc.binary_join_element_wise(words[:-1], words[1:], pa.scalar(" ", words.type)) if len(words) > 1 else words[:0]
        inside = np.flatnonzero(row[1:] == row[:-1])  # of one text
        place = pc.index_in(pa.concat_arrays([words, pairs.take(pa.array(inside))]), value_set=known)
        row = np.concatenate([row, row[inside]])
        found = np.flatnonzero(np.asarray(place.is_valid()))
        keys, tf = np.unique(row[found] * size + np.asarray(place.fill_null(0))[found], return_counts=True)
        row, place = np.divmod(keys, size)
        raw = tf * idf[place]
        values = raw / np.sqrt(np.bincount(row, raw * raw, n))[row]
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        return known, (pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(values)))

    return items


def _looked_up(docs: DataFrame, vocab: DataFrame, text_col: str, names: bool) -> DataFrame:
    """(text, indices or, with ``names``, terms, values) for each distinct text that has terms, where each task looks them up."""
    from spendlens.llm.common import ship

    ship(docs.sparkSession)
    texts = with_tokens(_distinct_texts(docs, text_col).select(text_col), text_col)
    items, first = _lookup(vocab), "terms" if names else "indices"

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trees.together(batches):
            known, (places, values) = items(trees.column(b, "_toks"))
            if names:
                places = pa.ListArray.from_arrays(places.offsets, known.take(places.values))
            out = pa.table([b[text_col], places, values], names=[text_col, first, "values"])
            yield from out.filter(pc.greater(pc.list_value_length(places), 0)).to_batches(PASSED)

    kinds = [texts.schema[text_col], T.StructField(first, T.ArrayType(T.StringType() if names else T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return texts.mapInArrow(looked_up, T.StructType(kinds))


def tfidf_items(docs: DataFrame, vocab: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("term",), frequent: float = FREQUENT) -> DataFrame:
    """(text, items (array of keep..., raw), norm) for each distinct text that has terms.

    For a vocabulary that no task may hold. Texts are shuffled, to find the different ones; their terms in at least
    ``frequent`` of the most frequent term's documents (few: a text has only so many terms) meet the vocabulary there, by a
    broadcast; the rows of the other terms, of which none is hot, are shuffled by term and then by text.
    """
    texts = with_terms(_distinct_texts(docs, text_col).select(text_col), text_col)
    tf = _term_counts(texts, text_col)
    weighted = lambda rows: rows.select(text_col, F.struct(*keep, (F.col("tf") * F.col("idf")).alias("raw")).alias("tr"))
    most = vocab.agg(F.max("df")).first()[0]
    common = small(vocab.where(F.col("df") >= frequent * most))
    rare = tf.join(common.select("term"), "term", "left_anti").join(vocab.where(F.col("df") < frequent * most), "term")
    rows = weighted(tf.join(common, "term")).unionByName(weighted(rare))
    items = rows.groupBy(text_col).agg(F.collect_list("tr").alias("items"), F.sum(F.col("tr.raw") * F.col("tr.raw")).alias("squares"))
    return items.select(text_col, "items", F.sqrt("squares").alias("norm"))


def tfidf_transform(docs: DataFrame, vocab: DataFrame, text_col: str = "text", frequent: float = FREQUENT) -> DataFrame:
    """(text, term, weight) for each distinct text: l2-normalised tf * idf. Texts are shuffled once, to find the different ones."""
    if is_small(vocab):
        rows = _looked_up(docs, vocab, text_col, True)
        return rows.select(text_col, F.explode(F.arrays_zip("terms", "values")).alias("tr")).select(text_col, F.col("tr.terms").alias("term"), F.col("tr.values").alias("weight"))
    items = tfidf_items(docs, vocab, text_col, frequent=frequent)
    return items.select(text_col, "norm", F.explode("items").alias("tr")).select(
        text_col, F.col("tr.term").alias("term"), (F.col("tr.raw") / F.col("norm")).alias("weight")
    )


def tfidf_vectors(docs: DataFrame, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, indices, values) for each distinct text with terms: its tf-idf vector by the places of ``indexed`` terms."""
    if is_small(vocab):
        return _looked_up(docs, vocab, text_col, False)
    items = tfidf_items(docs, vocab, text_col, ("index",)).withColumn("items", F.array_sort("items"))
    return items.select(text_col, F.transform("items", lambda x: x["index"].cast("int")).alias("indices"), F.transform("items", lambda x: x["raw"] / F.col("norm")).alias("values"))


# --- numeric / categorical --------------------------------------------------------------------------


def scale_stats(train: DataFrame, cols=NUMERIC_FEATURES) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def zscore(df: DataFrame, stats: DataFrame, cols=NUMERIC_FEATURES) -> DataFrame:
    """(x - mean) / std with population std from ``stats``; zero std -> 1."""
    row = stats.first()  # one row of scalars
    out = df
    for c in cols:
        mean, std = row[f"{c}__mean"], row[f"{c}__std"]
        scale = 1.0 if not std else float(std)
        out = out.withColumn(f"{c}_z", (F.col(c) - F.lit(float(mean or 0.0))) / F.lit(scale))
    return out


def encoder_vocab(train: DataFrame, cols=CATEGORICAL_FEATURES) -> DataFrame:
    """(feature, value, index): categories sorted per feature; unseen values get no index."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]))
    vals = train.select(each.alias("v")).select("v.*").distinct()  # one pass for all features
    w = Window.partitionBy("feature").orderBy("value")  # one partition per feature, distinct values only
    return vals.withColumn("index", (F.row_number().over(w) - 1).cast("int"))


def one_hot(df: DataFrame, vocab: DataFrame, cols=CATEGORICAL_FEATURES) -> DataFrame:
    """``df`` with ``<feature>_index``: where the feature's one stands; NULL (all zeros) for a value not in ``vocab``."""
    for c in cols:
        own = vocab.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("index").alias(f"{c}_index"))
        df = df.join(small(own), F.col(c).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
    return df


def label_index(df: DataFrame, label: str = "category") -> DataFrame:
    """(label, index) in sorted label order."""
    w = Window.orderBy(label)  # over the distinct labels only
    return df.select(label).distinct().withColumn("label_index", (F.row_number().over(w) - 1).cast("int"))


def class_weights(train: DataFrame, label: str = "category") -> DataFrame:
    """Balanced weights n / (k * n_c) per label."""
    from spendlens.sources.table import written

    counts = written(train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c")), "label-counts")  # one row a label
    n, k = counts.agg(F.sum("n_c"), F.count(F.lit(1))).first()  # two scalars
    return counts.select(label, (F.lit(n) / (F.lit(k) * F.col("n_c"))).alias("weight"))


def report(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per class and overall: precision, recall, f1, support (0 where undefined)."""
    a, p = F.col(actual), F.col(predicted)
    tp = pairs.where(a == p).groupBy(a.alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    support = pairs.groupBy(a.alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    pred = pairs.groupBy(p.alias("cls")).agg(F.count(F.lit(1)).alias("pred"))
    classes = support.select("cls").union(pred.select("cls")).distinct()  # a class may be predicted and never occur
    m = classes.join(tp, "cls", "left").join(pred, "cls", "left").join(support, "cls", "left").fillna(0, ["tp", "pred", "support"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = m.select(
        F.col("cls").alias("class"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )
    tot = per.agg(
        F.sum("support").alias("n"),
        F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    hits = m.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"))
    acc = hits.select(F.lit("accuracy").alias("class"), *[(F.col("tp") / F.col("n")).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("n").cast("bigint").alias("support"))
    avgs = tot.select(
        F.explode(
            F.array(
                F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                         F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support")),
                F.struct(F.lit("weighted avg").alias("class"), (F.col("wp") / F.col("n")).alias("precision"),
                         (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                         F.col("n").cast("bigint").alias("support")),
            )
        ).alias("r")
    ).select("r.*")
    overall = acc.unionByName(avgs.toDF(*acc.columns))
    return per.unionByName(overall)


# --- the forest -------------------------------------------------------------------------------------


VERSION = 2


@dataclass
class Model:
    """A trained classifier with all it needs: ``vocabulary`` (term, df, idf, index) stays a table, however many terms
    there are; ``pipeline`` holds scaling and encoders; ``report`` is that of the test part."""

    vocabulary: DataFrame
    pipeline: PipelineModel
    forest: trees.Forest
    terms: int
    labels: list[str]
    report: DataFrame

    def features(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The feature view of ``df`` (of it the columns ``keep``) with ``_tfidf``."""
        feats = feature_view(df)
        keep = feats.columns if keep is None else keep
        if self.terms <= LOOKUP_TERMS:
            return with_tfidf(feats, self.vocabulary, keep, max(self.terms, 1), "_tfidf")
        vectors = tfidf_vectors(feats.select(TEXT_FEATURE), self.vocabulary).select(TEXT_FEATURE, F.col("indices").alias("_indices"), F.col("values").alias("_values"))
        empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("_indices", "array<int>"), ("_values", "array<double>"))]
        rows = feats.join(vectors, TEXT_FEATURE, "left").select(*keep, *empty)  # what a Python task gets can't be pruned later
        return trees.with_vector(rows, "_indices", "_values", max(self.terms, 1), "_tfidf")


def with_tfidf(docs: DataFrame, vocab: DataFrame, keep: list[str], size: int, name: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``name``: the tf-idf vector of each row's text, as ``tfidf_vectors`` has it. For a
    vocabulary that a task may hold: each one looks its terms up, so no row is shuffled."""
    rows = with_tokens(docs, text_col).select(*keep, "_toks")
    items = _lookup(vocab)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trees.together(batches):  # a look-up prepares the whole vocabulary
            _, lists = items(trees.column(b, "_toks"))
            yield from b.select(keep).append_column(name, trees.vectors(*lists, size)).to_batches(PASSED)

    return rows.mapInArrow(vectors, T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, VectorUDT())]))


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """A sparse ml vector from its sorted indices and values, made by the JVM: read from its JSON form, as no SQL
    function builds one."""
    kind = T.StructType([T.StructField("v", VectorUDT())])
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), kind)["v"]


def feature_stages() -> list:
    """What turns the feature view with ``_tfidf`` into ``features``."""
    encoded = [f"_{c}_oh" for c in CATEGORICAL_FEATURES]
    indexes = [f"_{c}_idx" for c in CATEGORICAL_FEATURES]
    return [
        VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="_num_raw"),
        StandardScaler(inputCol="_num_raw", outputCol="_num", withMean=True, withStd=True),
        StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=indexes, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexes, outputCols=encoded, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["_tfidf", "_num", *encoded], outputCol="features"),
    ]


def train_model(df: DataFrame, num_trees: int = 250, max_depth: int = 30, seed: int = 42, test_fraction: float = 0.2) -> tuple[Model, DataFrame]:
    """Fit on the training part; returns the model and its predictions on the test part."""
    from spendlens.llm.common import ship
    from spendlens.sources.table import dropped, written

    ship(df.sparkSession)
    split = split_bounds(df, "category", test_fraction)
    rows = split.apply(df).drop("row_key")
    train = rows.where("split = 'train'").drop("split")
    vocabulary = written(indexed(tfidf_fit(feature_view(train).select(TEXT_FEATURE), n_docs=split.n_train)), "vocabulary")
    terms = vocabulary.count()
    if terms >= 2**31:
        raise ValueError(f"{terms} terms: a vector has at most {2**31 - 1} places")
    model = Model(vocabulary, PipelineModel(stages=[]), trees.Forest(terms, {}), terms, [], df.sparkSession.createDataFrame([], "class string"))
    weighted = class_weights(train)  # one row a label
    labels = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    weights = {r["category"]: float(r["weight"]) for r in weighted.collect()}
    # Every level passes over the training vectors: they are written for the time of the fit.
    kept = ["category", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    staged = written(model.features(train.where("category is not null"), kept).select("category", "_tfidf", *kept[1:]), "train")
    model.pipeline, model.labels = Pipeline(stages=feature_stages()).fit(staged), list(labels.labels)
    vectors = labels.transform(model.pipeline.transform(staged)).select(F.monotonically_increasing_id().alias("id"), F.col("label").cast("int").alias("label"), "features")
    size = vectors.first().features.size
    vectors = written(trees.with_parts(vectors, "features"), "train-vectors")
    model.forest = trees.grow(vectors, size, max(terms, 1), [weights[c] for c in model.labels], num_trees, max_depth, seed)
    dropped(staged, vectors)
    test = rows.where("split = 'test'").drop("split")
    predicted = written(predict(model, test), "test-predictions")
    model.report = report(predicted, "category", "predicted_category")
    return model, predicted


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Adds ``predicted_category``; the input keeps its columns."""
    from spendlens.llm.common import ship

    ship(df.sparkSession)
    out = model.pipeline.transform(model.features(df)).select(*df.columns, F.col("features").alias("_features"))
    return trees.predict(model.forest, out, model.labels, "predicted_category")


def save_model(model: Model, path: str) -> None:
    """Vocabulary, pipeline, forest, report, labels and feature lists as one folder; the file with the lists is written last, so
    a folder that has it is whole."""
    from spendlens.sources.table import delete, write_text

    spark = model.vocabulary.sparkSession
    delete(spark, f"{path}/package.json")
    model.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.forest.table(spark).write.mode("overwrite").parquet(f"{path}/forest")
    model.report.write.mode("overwrite").parquet(f"{path}/report")
    package = {
        "version": VERSION, "terms": model.terms, "labels": model.labels, "trees": len(model.forest.leaves), "cuts": list(model.forest.cuts.items()), "text_feature": TEXT_FEATURE,
        "numeric_features": NUMERIC_FEATURES, "categorical_features": CATEGORICAL_FEATURES,
    }
    write_text(spark, f"{path}/package.json", json.dumps(package))


def load_model(spark, path: str) -> Model | None:
    """The saved model, or None where there is none; one with other features or of another version is an error."""
    from spendlens.sources.table import read_text

    text = read_text(spark, f"{path}/package.json")
    if text is None:
        return None
    package = json.loads(text)
    features = (package.get("text_feature"), package.get("numeric_features"), package.get("categorical_features"))
    if package.get("version") != VERSION or features != (TEXT_FEATURE, NUMERIC_FEATURES, CATEGORICAL_FEATURES):
        raise ValueError(f"the model at {path} was saved with other features or by another version")
    forest = trees.Forest.of(spark.read.parquet(f"{path}/forest"), max(package["terms"], 1), dict(package["cuts"]), package["trees"])
    return Model(spark.read.parquet(f"{path}/vocabulary"), PipelineModel.load(f"{path}/pipeline"), forest, package["terms"], package["labels"], spark.read.parquet(f"{path}/report"))


def recategorize(spark, df: DataFrame, model_path: str) -> DataFrame:
    """The cleaned rows of ``df`` with ``category`` as the model predicts it; only cleaned when there is no model."""
    data = normalize(df)
    model = load_model(spark, model_path)
    if model is None:
        return data
    return predict(model, data).withColumn("category", F.col("predicted_category")).select(*data.columns)
