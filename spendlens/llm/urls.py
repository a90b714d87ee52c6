"""URL filter: rules, and gradient-boosted trees on lexical features for what no rule fits (operator 10, DataFrame functions only).

The trees are trained on the different URLs that a rule judges: of each verdict at most SAMPLE, those with the lowest hash,
weighted by the number of all rows of that verdict over the sampled URLs.
Features: lengths, depth, share of digits, entropy, numbers of parameters, labels and hyphens, and statistics of the
host's last two labels and of its last one: how many URLs have it, and the share of blocked ones among those a rule
judges, pulled towards the overall share.

Cases: a null URL, or one without "://", has an empty host and path and gets the method's verdict; if the rules judge
URLs one way only, that is the method's verdict for all, and "allow" if they judge none. Repeated rows are judged
each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, ascii_lower, small, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SAMPLE, TREES, DEPTH, PULL = 10_000, 20, 4, 20
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy", "parameters", "has_fragment",
    "site_urls", "site_blocked", "suffix_urls", "suffix_blocked",
]


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith(slash + path)


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, by_rule."""
    url, pattern = F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)([^?#]*)"
    rows = pages.select("page_id", url.alias("url"))
    rows = rows.select("page_id", "url", ascii_lower(F.regexp_extract("url", pattern, 1)).alias("host"), F.regexp_extract("url", pattern, 2).alias("path"))
    longest = sorted(rules, key=lambda r: -len(r[1]))
    pick = lambda what: F.coalesce(*[F.when(_fits(r[1]), F.lit(r[what])) for r in longest], F.lit(None).cast("string"))
    return rows.withColumns({"rule": pick(1), "by_rule": pick(0)})


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the host's last labels (site, suffix)."""
    url, host, path, n = F.col("url"), F.col("host"), F.col("path"), F.char_length("url")
    count = lambda c, sign: F.char_length(c) - F.char_length(F.replace(c, F.lit(sign), F.lit("")))
    digits = lambda c: F.char_length(F.regexp_replace(c, "[^0-9]", ""))
    signs = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return rows.withColumns({
        "url_length": n, "host_length": F.char_length(host), "path_length": F.char_length(path), "depth": count(path, "/"), "labels": count(host, "."),
        "hyphens": count(host, "-"), "digit_ratio": F.when(n > 0, digits(url) / n).otherwise(0.0), "host_digits": digits(host), "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": count(url, "="), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "site": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1),
    })


def featured(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """All features; the statistics cover every row."""
    rows = lexical(rows)
    blocked, known = (F.col("by_rule") == "block").cast("int"), F.col("by_rule").isNotNull().cast("int")
    sites = rows.groupBy("site", "suffix").agg(F.count(F.lit(1)).alias("urls"), F.sum(blocked).alias("blocked"), F.sum(known).alias("known"))
    sites = scratch.save(sites.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("blocked", "known")}), "sites")
    overall = sites.agg((F.sum("blocked") / F.nullif(F.sum("known"), F.lit(0))).alias("p")).first()["p"] or 0.0
    for name in ("site", "suffix"):
        one = sites.groupBy(name).agg(F.sum("urls").alias("urls"), F.sum("blocked").alias("blocked"), F.sum("known").alias("known"))
        rate = (F.col("blocked") + PULL * F.lit(float(overall))) / (F.col("known") + PULL)
        one = scratch.save(one.select(name, F.log1p("urls").alias(f"{name}_urls"), rate.alias(f"{name}_blocked")), name)
        rows = rows.join(small(one), name)
    return rows


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: one row per row of ``pages``."""
    scratch = Scratch(spark, "urls")
    rows = featured(scratch, judged(pages, rules))
    counts = {r["by_rule"]: r["count"] for r in rows.where("by_rule is not null").groupBy("by_rule").count().collect()}  # at most two
    if len(counts) < 2:
        rows = rows.withColumn("p_block", F.lit(float("block" in counts)))
    else:
        parts = []
        for verdict in counts:
            urls = rows.where(F.col("by_rule") == verdict).select("url", *FEATURES).dropDuplicates(["url"])
            parts.append(urls.orderBy(F.xxhash64("url"), "url").limit(sample).withColumn("label", F.lit(float(verdict == "block"))))
        train = scratch.save(parts[0].unionByName(parts[1]), "train")
        taken = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        each = {v: counts[v] / taken[float(v == "block")] for v in counts}
        train = train.withColumn("weight", F.when(F.col("label") == 1, each["block"]).otherwise(each["allow"]))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, weightCol="weight")
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(train)
        rows = model.transform(rows).withColumn("p_block", vector_to_array(F.col("probability"))[1])
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "p_block")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))
