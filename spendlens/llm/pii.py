"""Personal data: patterns, and terms that give protected entities away (operator 4, DataFrame functions only).

The patterns find emails, IP addresses, cards and phone numbers. A protected entity c is every value found, and what
values share, as most values occur once: the kind, an email's domain and its local part, the first three numbers of an
IP address, the first six digits of a card, a phone number without its last four digits. For each term t beside c the
corpus says how much t discloses: PMI(c; t) = log2(P(c | t) / P(c)) of the information IC(c) = -log2(P(c)) that c holds,
P(c) = df(c) / N. P(c | t) = (d + PRIOR * P(c)) / (df(t) - df(c, t) / m + PRIOR), with m the different texts that have both
and d = df(c, t) * (m - 1) / m, is smoothed and leaves the text itself (the mean of its copies) out: what t tells of c must
be known from other texts, so copies of one text prove nothing. A term that holds at least REMOVE of IC(c) is removed, one
that holds at least GENERALISE is generalised (to its first letter), in the texts with that entity. Any word may be a term,
numbers and parts of the value as well: they are told from the value by their place. Only for the kinds, which all values
share, the words inside values are no terms. Document counts cover all rows.

Kinds of spans: email, ip, card, phone (base), then remove, general. Spans are code points, end exclusive. Patterns use
possessive repeats: what follows a repeat is never of its class, so nothing else could match, and no text makes them
slow or deep.

Cases: null counts as empty; texts without entities get no added spans; repeated rows each get theirs (and count as
documents). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, ascii_lower, sha_of, small, span_strings, spans, table, tagged, text_of, words

KINDS = ["email", "ip", "card", "phone", "remove", "general"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PRIOR, REMOVE, GENERALISE = 1 / 16, 0.98, 0.9
COMMON = 0.001  # share of the rows from which on an entity counts as common
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
KEY = ["doc_id", "tkey"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right but one is doubled, less 9 above 9; the sum must end in 0."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, 1)) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """The valid matches of each base kind."""
    octet = lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) < 3) | ((F.char_length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255"))
    ip = F.filter(spans(text, IP), lambda x: F.forall(F.split(x["m"], r"\."), octet))
    card = F.filter(spans(text, CARD), lambda x: F.when(F.char_length(_digits(x["m"])).between(12, 19), _luhn(_digits(x["m"]))).otherwise(False))
    phone = F.filter(spans(text, PHONE), lambda x: F.char_length(_digits(x["m"])).between(9, 15))
    return [spans(text, EMAIL), ip, card, phone]


def found_table(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """KEY, the base spans of each kind, and the text where there are any."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))
    rows = rows.select(*KEY, "text", *[c.alias(k) for k, c in zip(KINDS, base_spans(F.col("text")), strict=False)])
    any_ = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    return scratch.save(rows.withColumn("text", F.when(any_, F.col("text"))), "found")


def _entities(kind: str) -> Column:
    """The kind where there is a value, the values, and what values share."""
    plain = F.transform(F.col(kind), lambda x: (_digits if kind in ("card", "phone") else ascii_lower)(x["m"]))
    parts = {
        "email": [("@", lambda v: F.substring_index(v, "@", -1)), ("=", lambda v: F.substring_index(v, "@", 1))],
        "ip": [("/", lambda v: F.substring_index(v, ".", 3))],
        "card": [("/", lambda v: F.left(v, F.lit(6)))],
        "phone": [("/", lambda v: F.left(v, F.char_length(v) - 4))],
    }[kind]
    own = F.when(F.size(kind) > 0, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    tag = lambda sign, part: F.transform(plain, lambda v: F.concat(F.lit(kind + sign), part(v)))
    return F.concat(own, tag(":", lambda v: v), *[tag(*p) for p in parts])


def disclosing(scratch: Scratch, docs: DataFrame, found: DataFrame) -> DataFrame:
    """KEY, terms (array<struct<term, level>>): what to remove (4) or generalise (5) in each text with entities."""
    base = F.array_sort(F.concat(*[tagged(F.col(k), i) for i, k in enumerate(KINDS[:4])]))
    outside = words(_replaced(F.col("text"), base, lambda x: F.lit(" ")))
    own = F.struct(
        F.array_distinct(F.concat(*[_entities(k) for k in KINDS[:4]])).alias("entities"),
        F.array_distinct(words(F.col("text"))).alias("words"), F.array_distinct(outside).alias("outside"),
    )
    # One row for each different text, with the number of its copies.
    texts = found.where("text is not null").select("tkey", own.alias("own")).groupBy("tkey").agg(F.count(F.lit(1)).alias("copies"), F.first("own").alias("own"))
    texts = scratch.save(texts.select("tkey", "copies", "own.*"), "texts")
    total = max(docs.count(), 1)
    entities = texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg((F.sum("copies") / F.lit(float(total))).alias("p"))
    terms = docs.select(F.explode(F.array_distinct(words(text_of()))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    # PMI >= GENERALISE * IC means P(c | t) >= P(c) ** (1 - GENERALISE), and P(c) is at least 1 / N.
    least = 0.999 * total ** (GENERALISE - 1)
    # With e rows beside any entity, d <= e, and as m = 1 gives PMI <= 0, df(t) - df(c, t) / m >= df(t) - e / 2. So a term
    # that is below the least with these bounds discloses nothing, and is left out before any pair is made.
    own = texts.select("copies", F.explode(F.array_union("words", "outside")).alias("term")).groupBy("term").agg(F.sum("copies").alias("e"), F.count(F.lit(1)).alias("m")).where("m > 1")
    open_ = own.join(terms, "term").where((F.col("e") + PRIOR) / (F.col("df_t") - F.col("e") / 2 + PRIOR) >= least)
    open_ = scratch.save(open_.select("term", "df_t"), "open")
    held = texts.select("tkey", F.explode(F.array_union("words", "outside")).alias("term")).join(open_.select("term"), "term")
    held = held.groupBy("tkey").agg(F.collect_set("term").alias("open"))
    cut = scratch.save(texts.join(held, "tkey").select("tkey", "copies", "entities", F.array_intersect("words", "open").alias("words"), F.array_intersect("outside", "open").alias("outside")), "cut")
    beside = cut.select("tkey", "copies", "words", "outside", F.explode("entities").alias("entity"))
    own_words = F.when(F.col("entity").isin(KINDS[:4]), F.col("outside")).otherwise(F.col("words"))
    beside = beside.select("tkey", "copies", "entity", F.explode(own_words).alias("term"))
    pairs = beside.groupBy("entity", "term").agg(F.sum("copies").alias("df_ct"), F.count(F.lit(1)).alias("m")).where("m > 1")
    d, rest = F.col("df_ct") * (F.col("m") - 1) / F.col("m"), F.col("df_t") - F.col("df_ct") / F.col("m")
    pairs = scratch.save(pairs.join(open_, "term").where((d + PRIOR) / (rest + PRIOR) >= least), "pairs")
    # Entities of many rows have many terms; they are few, and are joined apart.
    common = F.col("p") >= COMMON
    pairs = pairs.join(small(entities.where(common)), "entity").unionByName(pairs.join(entities.where(~common), "entity"))
    pmi, ic = F.log2((d + PRIOR * F.col("p")) / (rest + PRIOR) / F.col("p")), -F.log2("p")
    level = F.when(pmi >= REMOVE * ic, 4).when(pmi >= GENERALISE * ic, 5)
    # An entity in every text holds no information (ic = 0), so nothing can disclose it.
    flagged = scratch.save(pairs.where(ic > 0).withColumn("level", level).where("level is not null").select("entity", "term", "level"), "flagged")
    out = beside.join(flagged, ["entity", "term"]).groupBy("tkey", "term").agg(F.min("level").alias("level"))
    return scratch.save(out.groupBy("tkey").agg(F.collect_list(F.struct("term", "level")).alias("terms")), "terms")


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitized (null where nothing is to hide)."""
    scratch = Scratch(spark, "pii")
    found = found_table(scratch, docs)
    terms = disclosing(scratch, docs, found)
    bare = found.where("text is null").withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType))
    full = found.where("text is not null").join(terms, "tkey", "left").select(*found.columns, "terms")
    rows = full.unionByName(bare)
    base = F.concat(*[tagged(F.col(k), i) for i, k in enumerate(KINDS[:4])])
    regex = F.concat(F.lit(f"(?<!{WORD})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(f")(?!{WORD})"))
    levels = F.map_from_entries(F.col("terms"))
    hits = F.transform(spans(ascii_lower(F.col("text")), regex), lambda x: F.struct(x["s"].alias("s"), F.get(F.filter(F.map_entries(levels), lambda m: m["key"] == x["m"]), F.lit(0))["value"].alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("base", base).withColumn("hits", F.when(F.col("terms").isNotNull(), hits).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")))
    added = F.filter("hits", lambda h: ~F.exists("base", lambda b: (h["s"] < b["e"]) & (h["e"] > b["s"])))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", added)))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        sha_of(F.array_join(span_strings(KINDS, F.col("base")), ",")).alias("base_sha256"),
        F.array_join(span_strings(KINDS, F.col("all")), ",").alias("spans"),
        F.when(F.size("all") > 0, _rewritten(F.col("text"), F.col("all"))).alias("sanitized"),
    )


def _rewritten(text: Column, found: Column) -> Column:
    """The text with base spans as [kind], removed terms gone and generalised ones as their first letter and a star."""

    def shown(x: Column) -> Column:
        own = F.concat(F.lit("["), F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), F.lit("]"))
        return F.when(x["k"] < 4, own).when(x["k"] == 4, "").otherwise(F.concat(text.substr(x["s"] + 1, F.lit(1)), F.lit("*")))

    return _replaced(text, found, shown)


def _replaced(text: Column, found: Column, shown: Callable[[Column], Column]) -> Column:
    """The text with ``shown`` of each span in its place.

    Base spans of different kinds may overlap; the part of a span that an earlier one covers is gone with that one.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        between = text.substr(acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], between, shown(x)).alias("out"))

    return F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.char_length(text))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(spark, table(spark, sf_dir, "documents")).drop("sanitized")
