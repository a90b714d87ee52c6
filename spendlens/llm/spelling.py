"""Spelling variants of corpus words by Bloom-guided neighbourhoods (operator 13).

Spark counts the corpus words. Two words are near if one inserted, deleted or replaced code point tells them apart.
Instead of comparing words, each task generates the edits of its words, as hashes only, and probes them against blocked
Bloom filters of the vocabulary, one filter for each word length (longer words share one). The few edits that a filter
lets through are spelled out and shuffled to an exact join with the vocabulary, which drops the false ones. A pair is
generated once: from the longer word by a deletion, from the lower one by a replacement with a higher code point.

The filters are broadcast, FILTER_WORDS 64-bit blocks (32 MB) at most: a vocabulary that needs more is cut by hash into slices
and probed slice by slice, so nothing is left out and what is sent out at once never grows.

A word's form is its most frequent near word, if that one is RATIO times as frequent; its root is where its forms end.
Frequencies grow by RATIO (above 1) from form to form, so paths end and are short; they are halved in each round.

Cases: null texts have no words; a null id is hashed as an empty string; repeated rows count each for themselves; words
of any length are compared, in blocks of positions; without words the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import Scratch, ascii_lower, table, text_of
from spendlens.llm.shingles import mix

LEAST, SEEN, RATIO = 6, 5, 5  # code points of a word, occurrences, and how much more frequent a form is
EVERY = 199  # of the runs, about one in so many loses a code point
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.int64)  # what an edit may bring in
POOLED = 40  # words from this length on share a filter
KEY_BITS, SET_BITS = 24, 4  # of the filter for each word, and set by each word in its block
FILTER_WORDS = 2**22
PROBES = 500_000  # edits probed at once
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def corpus_words(docs: DataFrame, every: int = EVERY, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """word, n: the distinct words of at least ``least`` code points and ``seen`` occurrences."""
    letters = f"[a-zÀ-ÿ]{{{least},}}+"  # shorter runs give no words
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(text_of()), F.lit(letters), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    run = F.col("run")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    found = runs.select(F.when(h % every == 0, cut).otherwise(run).alias("word")).where(F.char_length("word") >= least)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)


def _signs(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(_U) + _STEP)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _STEP)]))


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row numbers, words) of each length; no more words at once than PROBES signs, one at least."""
    words = words.to_pylist()
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, PROBES // int(size))
        for i in range(0, len(rows), step):
            yield rows[i : i + step], [words[r] for r in rows[i : i + step]]


class Filters:
    """Where each word length's blocks lie in one slice; a hash sets SET_BITS bits of one 64-bit block."""

    def __init__(self, counts: dict[int, int], slices: int):
        self.slices, self.first, self.blocks, at = slices, np.zeros(POOLED + 1, np.int64), np.ones(POOLED + 1, np.int64), 0
        for size in range(POOLED + 1):
            self.first[size] = at
            self.blocks[size] = max(1, -(-counts.get(size, 0) * KEY_BITS // (64 * slices)))
            at += int(self.blocks[size])
        self.total = at

    def place(self, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice, block, bits) of words of one length given by their polynomial hashes."""
        shard = min(size, POOLED)
        h = mix(sums + _U(size * 0x632BE59BD9B4E019 % 2**64))
        block = self.first[shard] + ((h >> _U(32)) * _U(int(self.blocks[shard])) >> _U(32)).astype(np.int64)
        g = mix(h + _STEP)
        bits = np.zeros(len(h), _U)
        for i in range(SET_BITS):
            bits |= _U(1) << ((g >> _U(6 * i)) & _U(63))
        return ((g >> _U(32)) % _U(self.slices)).astype(np.int64), block, bits


def _set(batches: Iterator[pa.RecordBatch], filters: Filters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, words in _by_length(batch.column(0)):
            codes = _codes(words)
            sums = (_signs(codes) * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=_U)
            part, block, bits = filters.place(sums, codes.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(block), pa.array(bits.view(np.int64))], ["slice", "block", "bits"])


def _edits(words: list[str], held: np.ndarray, filters: Filters, slice_: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places in ``words``, edits) that the filter of one slice lets through."""
    codes = _codes(words)
    m, size = codes.shape
    signs, powers = _signs(codes), _powers(size)
    terms = signs * powers[:-1]
    before = np.concatenate([np.zeros((m, 1), _U), np.cumsum(terms, axis=1, dtype=_U)], axis=1)
    letters = _signs(LETTERS)

    def passed(sums: np.ndarray, length: int) -> np.ndarray:
        part, block, bits = filters.place(sums, length)
        return ((held[block] & bits) == bits) & (part == slice_)

    # Of a run of equal signs the first is deleted: the others would give the same word.
    row, at = np.nonzero(np.concatenate([np.ones((m, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1))
    for i in range(0, len(row) if size > 1 else 0, PROBES):
        r, p = row[i : i + PROBES], at[i : i + PROBES]
        ok = passed(before[r, p] + (before[r, -1] - before[r, p + 1]) * _BACK, size - 1)
        if ok.any():
            yield r[ok], [words[x][:y] + words[x][y + 1 :] for x, y in zip(r[ok].tolist(), p[ok].tolist(), strict=True)]
    flat = max(1, PROBES // len(LETTERS))
    for i in range(0, m * size, flat):
        r, p = np.divmod(np.arange(i, min(i + flat, m * size)), size)
        x, c = np.nonzero(LETTERS[None, :] > codes[r, p][:, None])
        ok = passed(before[r[x], -1] + (letters[c] - signs[r[x], p[x]]) * powers[p[x]], size)
        if ok.any():
            x, c = x[ok], c[ok]
            yield r[x], [words[a][:b] + chr(d) + words[a][b + 1 :] for a, b, d in zip(r[x].tolist(), p[x].tolist(), LETTERS[c].tolist(), strict=True)]


def _probe(batches: Iterator[pa.RecordBatch], sent: Broadcast, filters: Filters, slice_: int) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(sent.value, _U)
    for batch in batches:
        for rows, words in _by_length(batch.column(0)):
            for at, edits in _edits(words, held, filters, slice_):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), batch.column(1).take(pa.array(rows[at])), pa.array(edits, pa.string())], ["word", "n", "other"])


def near_pairs(scratch: Scratch, vocabulary: DataFrame, most: int = FILTER_WORDS) -> DataFrame:
    """word, n, other, other_n: every pair of near words of ``vocabulary`` (word, n), once."""
    spark = scratch.spark
    shard = F.least(F.char_length("word"), F.lit(POOLED))
    counts = {int(r["shard"]): int(r["words"]) for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("words")).collect()}  # POOLED + 1 rows at most
    needed = sum(counts.values()) * KEY_BITS // 64 + POOLED + 1
    filters = Filters(counts, max(1, -(-needed // max(1, most - POOLED - 1))))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _set(batches, filters)

    bits = vocabulary.select("word").mapInArrow(set_bits, "slice long, block long, bits long").groupBy("slice", "block").agg(F.bit_or("bits").alias("bits"))
    bits = scratch.save(bits, "bits")
    pairs = None
    for slice_ in range(filters.slices):
        own = bits.where(F.col("slice") == slice_).select("block", "bits").toArrow()  # filters.total rows at most
        held = np.zeros(filters.total, _U)
        held[own.column("block").to_numpy()] = own.column("bits").to_numpy().view(_U)
        sent = spark.sparkContext.broadcast(held.tobytes())

        def probe(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, slice_: int = slice_) -> Iterator[pa.RecordBatch]:
            return _probe(batches, sent, filters, slice_)

        maybe = vocabulary.repartition("word").mapInArrow(probe, "word string, n long, other string")
        exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
        found = scratch.save(maybe.join(exact, "other").select("word", "n", "other", "other_n"), "pairs")
        sent.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root: where the path of forms (word, form) from each word ends."""
    now = scratch.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = scratch.save(new, "roots")
        scratch.drop(now)
        now = new
    return now.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, ratio: int = RATIO, most: int = FILTER_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per corpus word."""
    scratch = Scratch(spark, "spelling")
    vocabulary = scratch.save(corpus_words(docs), "words")
    pairs = near_pairs(scratch, vocabulary, most)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    named = vocabulary.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    named = scratch.save(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "named")
    ends = roots(scratch, named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, table(spark, sf_dir, "documents"))
