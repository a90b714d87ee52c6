"""Benchmark decontamination with a distributed positional inverted index (operator 1, DataFrame functions only).

The index is a table of postings (term, document, position), one row per token of the training text, written
where the documents are read (no shuffle) and read back by column. A test item is looked up from its rarest
terms: in each window of 13 words the two terms with the shortest posting lists are its anchors. A posting
minus its anchor's place in the item is the offset-adjusted start; documents where both anchor lists of a
window agree on the start are candidates. Every candidate is then compared word by word with its item. Beside these
exact matches, documents where the three rarest terms of a window stand within SLOP words of their places are proximity matches.

Cases: null text has no words; a document without words has n_words 0 and is clean; items without words or with
a null id have no windows; repeated rows each get their result; repeated items count once. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, same, sha_of, small, table, text_of, word_pieces, words

WINDOW = 13
SLOP, RAREST = 8, 3  # of proximity matches: words, terms
KEY = ["doc_id", "tkey"]  # a document: its id and a hash of its text, so that a repeated id does no harm


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))


def build_index(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The postings: term (hash), doc_id, tkey, pos."""
    rows = keyed(docs).select(*KEY, F.posexplode(word_pieces(F.col("text"))).alias("pos", "word")).where("word != ''")
    return scratch.save(rows.select(F.xxhash64("word").alias("term"), *KEY, "pos"), "postings")


def test_items(scratch: Scratch, benchmark: DataFrame) -> DataFrame:
    """ikey, item_id, words, n, k (length of a window) of the items that have words."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text")).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("ikey"), "item_id", words(F.col("text")).alias("words"))
    return scratch.save(items.withColumn("n", F.size("words")).where("n > 0").withColumn("k", F.least("n", F.lit(WINDOW))), "items")


def anchored(scratch: Scratch, postings: DataFrame, items: DataFrame, rarest: int) -> DataFrame:
    """ikey, n, anchors (array<struct<q, term>>): the rarest terms of each window that has only known terms."""
    places = items.select("ikey", F.posexplode("words").alias("q", "word")).select("ikey", "q", F.xxhash64("word").alias("term"))
    terms = scratch.save(places.select("term").distinct(), "terms")
    lengths = scratch.save(postings.join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "lengths")
    rows = places.join(small(lengths), "term", "left").groupBy("ikey").agg(F.array_sort(F.collect_list(F.struct("q", "term", "df"))).alias("places"))
    rows = rows.join(items.select("ikey", "n", "k"), "ikey")
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda s: F.slice("places", s, F.col("k")))
    known = F.filter(windows, lambda w: F.forall(w, lambda x: x["df"].isNotNull()))
    by_df = F.transform(known, lambda w: F.array_sort(F.transform(w, lambda x: F.struct(x["df"].alias("df"), x["q"].alias("q"), x["term"].alias("term")))))
    first = F.transform(by_df, lambda w: F.transform(F.slice(w, 1, rarest), lambda x: F.struct(x["q"].alias("q"), x["term"].alias("term"))))
    return scratch.save(rows.select("ikey", "n", F.explode(F.array_distinct(first)).alias("anchors")), "anchors")


def emitted(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each posting of an anchor: KEY, ikey, q, start (where the item would begin in the document)."""
    lists = anchors.select("ikey", F.explode("anchors").alias("a")).select("ikey", "a.q", "a.term").distinct()
    return postings.join(small(lists), "term").select(*KEY, "ikey", "q", (F.col("pos") - F.col("q")).alias("start"))


def phrase_candidates(scratch: Scratch, postings: DataFrame, items: DataFrame) -> DataFrame:
    """KEY, ikey, start, n where the offset-adjusted lists of both anchors of some window meet."""
    anchors = anchored(scratch, postings, items, 2)
    met = emitted(postings, anchors).groupBy(*KEY, "ikey", "start").agg(F.collect_set("q").alias("qs"))
    sets = anchors.groupBy("ikey", "n").agg(F.collect_set(F.transform("anchors", lambda a: a["q"])).alias("sets"))
    whole = F.exists("sets", lambda s: F.size(F.array_intersect(s, F.col("qs"))) == F.size(s))
    return met.join(small(sets), "ikey").where(whole).select(*KEY, "ikey", "start", "n")


def proximity_matches(scratch: Scratch, postings: DataFrame, items: DataFrame, slop: int = SLOP, rarest: int = RAREST) -> DataFrame:
    """KEY, item_id: the ``rarest`` rarest terms of a window stand in the document, in any order, no more than
    ``slop`` words from where the phrase has them. Starts are put in overlapping ranges, so no pair is formed."""
    anchors = anchored(scratch, postings, items, rarest).withColumn("win", F.xxhash64("ikey", "anchors"))
    lists = anchors.select("ikey", "win", F.size("anchors").alias("need"), F.explode("anchors").alias("a")).select("ikey", "win", "need", "a.q", "a.term")
    rows = postings.join(small(lists), "term").withColumn("start", F.col("pos") - F.col("q"))
    low = F.floor(F.col("start") / (slop + 1))
    rows = rows.withColumn("range", F.explode(F.array(low - 1, low)))
    near = rows.groupBy(*KEY, "ikey", "win", "need", "range").agg(F.collect_set(F.struct("start", "q")).alias("at"))
    whole = F.exists("at", lambda a: F.size(F.array_distinct(F.transform(F.filter("at", lambda b: (b["start"] >= a["start"]) & (b["start"] <= a["start"] + slop)), lambda b: b["q"]))) == F.col("need"))
    return near.where(whole).join(items.select("ikey", "item_id"), "ikey").select(*KEY, "item_id").distinct()


def _hit_places(doc: Column, item: Column, start: Column, k: Column) -> Column:
    """Places in the document of all windows of the item that occur when the item begins at ``start``."""
    low, high = F.greatest(F.lit(0), -start), F.least(F.size(item), F.size(doc) - start)
    length = F.greatest(high - low, F.lit(0))
    equal = F.zip_with(F.slice(doc, F.greatest(low + start + 1, F.lit(1)), length), F.slice(item, low + 1, length), lambda a, b: F.when(a == b, "1").otherwise("0"))
    bits, run = F.array_join(equal, ""), F.repeat(F.lit("1"), k)
    starts = F.filter(F.sequence(F.lit(1), high - low - k + 1), lambda s: bits.substr(s, k) == run)
    places = F.flatten(F.transform(starts, lambda s: F.sequence(s + low + start - 1, s + low + start + k - 2)))
    return F.when(high - low >= k, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def phrase_matches(scratch: Scratch, docs: DataFrame, postings: DataFrame, items: DataFrame) -> DataFrame:
    """KEY, item_id, places: the document words inside occurring windows of the item."""
    found = phrase_candidates(scratch, postings, items)
    found = scratch.save(found.groupBy(*KEY).agg(F.collect_list(F.struct("ikey", "start", "n")).alias("at")), "candidates")
    own = keyed(docs)
    rows = found.hint("shuffle_hash").join(own, same(found, own, KEY)).select(own["doc_id"], own["tkey"], word_pieces(own["text"]).alias("doc"), "at")
    # Only the words that an item can cover go on with each candidate.
    cut = F.transform("at", lambda a: F.struct(a["ikey"].alias("ikey"), a["start"].alias("start"), F.greatest(a["start"], F.lit(0)).alias("low"), F.slice("doc", F.greatest(a["start"], F.lit(0)) + 1, a["n"]).alias("doc")))
    rows = rows.select(*KEY, F.explode(cut).alias("c")).select(*KEY, "c.*").join(small(items), "ikey")
    here = _hit_places(F.col("doc"), F.col("words"), F.col("start") - F.col("low"), F.col("k"))
    rows = rows.withColumn("places", F.transform(here, lambda p: p + F.col("low"))).where("size(places) > 0")
    return rows.select(*KEY, "item_id", "places")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, proximity: bool = False) -> DataFrame:
    """doc_id, tkey, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    With ``proximity`` also n_near: items of which some window has its rarest terms near to each other in the document (``proximity_matches``); a
    whole window has them so, and one with words put in, left out or moved may.
    """
    scratch = Scratch(spark, "decontaminate")
    postings, items = build_index(scratch, docs), test_items(scratch, benchmark)
    hits = phrase_matches(scratch, docs, postings, items).groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = scratch.save(hits.select(*KEY, F.size("places").cast("long").alias("n_hit"), "items"), "hits")
    # Positions run without a gap, so the span is the number of words even where a row is repeated.
    sizes = scratch.save(postings.groupBy(*KEY).agg((F.max("pos") - F.min("pos") + 1).cast("long").alias("n_words")), "sizes")
    near = None
    if proximity:
        near = proximity_matches(scratch, postings, items).groupBy(*KEY).agg(F.count_distinct("item_id").alias("n_near"))
        near = scratch.save(near, "near")
    scratch.drop(postings)
    own = keyed(docs).select(*KEY)
    out = own.join(sizes, same(own, sizes, KEY), "left").select(own["doc_id"], own["tkey"], "n_words")
    out = out.join(hits, same(out, hits, KEY), "left").select(out["doc_id"], out["tkey"], "n_words", "n_hit", "items")
    if near is not None:
        out = out.join(near, same(out, near, KEY), "left").select(out["doc_id"], out["tkey"], "n_words", "n_hit", "items", "n_near")
    n_words, n_hit = F.coalesce("n_words", F.lit(0).cast("long")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *KEY, n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
        sha_of(F.coalesce(F.array_join("items", ","), F.lit(""))).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
        *([] if near is None else [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")]),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=True).drop("tkey")
