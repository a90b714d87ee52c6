"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased: all of ASCII but digits and small letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that a broadcast may have; a side with more rows is joined by a shuffle.
BROADCAST_ROWS = 200_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once per application: they need not find it where the driver does."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    path = f"{shared_dir(spark)}/llm/package-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one run, in a folder of its own under the shared folder.

    A written table cuts the lineage: a lost executor costs its own tasks only. ``drop`` frees a table
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        if _SCOPES:
            _SCOPES[-1].append(self)
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch_path"] = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_scratch_path"])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def end(self) -> None:
        """Frees all tables; nothing that reads them may come after."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SCOPES: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Ends every Scratch made inside, for a caller that has stored the result by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.end()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``most`` rows, else ``df`` itself."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` alone would change accented letters too)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def one_text(rows: DataFrame, *names: str) -> DataFrame:
    """One row for each ``names`` (and of its texts the one with the lowest hash): a repeated id stays one sampled row."""
    lowest = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    return rows.groupBy(*names).agg(lowest.alias("text"))


def word_pieces(c: Column) -> Column:
    """The lower-cased words in order; the first and the last piece may be empty."""
    return F.split(ascii_lower(c), SEPARATOR, -1)


def words(c: Column) -> Column:
    return F.filter(word_pieces(c), lambda w: w != "")


def same(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    """Null-safe equality on all ``names``."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def sha_of(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def spans(text: Column, regex: str | Column) -> Column:
    """All leftmost non-overlapping matches as array<struct<s, e, m>>, in code points, end exclusive.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the pieces between matches and the
    matches take turns and their lengths add up to the places.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    pieces, found = F.call_function("split", text, regex, F.lit(-1)), F.call_function("regexp_extract_all", text, regex, F.lit(0))
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def add(acc: Column, x: Column) -> Column:
        s = F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0)) + x["gap"]
        return F.concat(acc, F.array(F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), x["m"].alias("m"))))

    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(steps, none, add))


def span_strings(kinds: list[str], found: Column) -> Column:
    """array<struct<s, k, e>> (k: place in ``kinds``) as kind:start:end strings, by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")))


def tagged(found: Column, k: int) -> Column:
    """The spans of kind ``k`` in the form that ``span_strings`` sorts."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
