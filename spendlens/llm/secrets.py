"""Secrets: patterns, and strings that a character model finds random (operator 6, DataFrame functions only).

Two Markov models of character pairs, one of random strings and one of ordinary identifiers, are trained on labelled
samples: the values that the patterns find are random, long strings outside them are ordinary. A long string is a secret
too if its mean log-likelihood ratio per character is above 0 and above the middle between the medians of the two
samples. Pair counts and medians cover every string of the corpus.

Kinds of spans: assign, access, hex (base), then random. Spans are code points, end exclusive. Possessive repeats as in
pii.py. Cases: null counts as empty; without samples of both labels no span is added; repeated rows each get theirs.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, sha_of, span_strings, spans, table, tagged, text_of

KINDS = ["assign", "access", "hex", "random"]
NAME, REST = "(?i:password|passwd|secret|token|api_?key)", r"""["']?\x20*+[:=]\x20*+["']?"""
ASSIGN, VALUE = NAME + REST + "[A-Za-z0-9+/_.=-]++", "^" + NAME + REST + "([A-Za-z0-9+/_.=-]++)$"
ACCESS, HEX = "AKIA[A-Z0-9]++", "(?<![0-9a-f])[0-9a-f]{24,}+"
LONG = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
FIRST, SIGNS = 32, 96  # printable ASCII


def base_spans(text: Column) -> list[Column]:
    assign = F.filter(spans(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], VALUE, 1)) >= 6)
    access = F.filter(spans(text, ACCESS), lambda x: F.char_length(x["m"]) >= 20)
    return [assign, access, spans(text, HEX)]


def found_table(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind, and the long strings outside them."""
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in zip(KINDS, base_spans(F.col("text")), strict=False)], spans(F.col("text"), LONG).alias("long"))
    base = F.concat("assign", "access", "hex")
    outside = F.filter("long", lambda h: ~F.exists(base, lambda b: (h["s"] < b["e"]) & (h["e"] > b["s"])))
    return scratch.save(rows.withColumn("long", outside), "found")


def pairs_of(word: Column) -> Column:
    """Each pair of neighbouring characters as one number; the pair before the first has a space."""
    code = lambda i: F.ascii(F.substring(word, i, 1)) - FIRST
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.when(i > 1, code(i - 1)).otherwise(0) * SIGNS + code(i))


def samples(found: DataFrame) -> DataFrame:
    """word, secret (0 or 1), n: the labelled strings and how often each occurs."""
    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["m"], VALUE, 1)), F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))
    secret = found.select(F.explode(values).alias("word"), F.lit(1).alias("secret"))
    plain = found.select(F.explode(F.transform("long", lambda x: x["m"])).alias("word"), F.lit(0).alias("secret"))
    return secret.unionByName(plain).groupBy("word", "secret").agg(F.count(F.lit(1)).alias("n"))


def ratios(pairs: list) -> list[float]:
    """log2 P(b | a, random) / P(b | a, ordinary) for all pairs, each count plus one half. ``pairs``: at most 2 * SIGNS ** 2 rows."""
    import math

    count = [[0.5] * SIGNS**2 for _ in range(2)]
    for r in pairs:
        count[r["secret"]][r["pair"]] += r["n"]
    # A character that a model has hardly met counts as met an average number of times: the rest is unknown.
    after = [[max(sum(c[a * SIGNS : (a + 1) * SIGNS]), sum(c) / SIGNS) for a in range(SIGNS)] for c in count]
    return [math.log2(count[1][i] / after[1][i // SIGNS]) - math.log2(count[0][i] / after[0][i // SIGNS]) for i in range(SIGNS**2)]


def mean_ratio(word: Column, table_: Column) -> Column:
    total = F.aggregate(pairs_of(word), F.lit(0.0), lambda a, p: a + F.get(table_, p))
    return total / F.char_length(word)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``."""
    scratch = Scratch(spark, "secrets")
    found = found_table(scratch, docs)
    words = scratch.save(samples(found), "words")
    # Each different string counts once: a secret that is copied a thousand times is one sample.
    pairs = words.select("secret", F.explode(pairs_of(F.col("word"))).alias("pair")).groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    if {r["secret"] for r in pairs} == {0, 1}:
        numbers = F.from_json(F.lit(str(ratios(pairs))), "array<double>")
        medians = words.select("secret", mean_ratio(F.col("word"), numbers).alias("r")).groupBy("secret").agg(F.percentile_approx("r", 0.5, 10_000).alias("r")).collect()
        least = max(0.0, sum(r["r"] for r in medians) / 2)
        random = F.filter("long", lambda x: mean_ratio(x["m"], numbers) > least)
        added = F.transform(random, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    else:
        added = none
    base = F.concat(*[tagged(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        sha_of(F.array_join(span_strings(KINDS, base), ",")).alias("base_sha256"),
        F.array_join(span_strings(KINDS, F.concat(base, added)), ",").alias("spans"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
