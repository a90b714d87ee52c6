"""Words and word shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_STEP, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CODE = np.arange(256, dtype=np.uint64)
_CODE[0x41:0x5B] += _U(32)
#: Bytes that are taken at once; a longer text is taken alone, its words in parts of about so many bytes.
CHUNK = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(_CODE + _STEP)
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK - 1, x)])) for x in (_STEP, _BACK))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** i and _STEP ** -i mod 2**64 for i below n."""
    if n <= CHUNK:
        return _UP[:n], _DOWN[:n]
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_STEP, _BACK))


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK bytes each, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        yield start, stop
        start = stop


def word_hashes(texts: pa.Array, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash): the row and a 64-bit hash of each lower-cased word, in order. Null counts as empty.

    With ``first``, only longer words, and of these the first so many bytes.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    offsets = offsets - low
    docs, hashes, start = [], [], 0
    while start < len(data):
        stop = _part_end(data, start)
        here = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, side="right")]
        starts, own = _hashed(data[start:stop], here - start, first)
        docs.append(np.searchsorted(offsets, starts + start, side="right") - 1)
        hashes.append(own)
        start = stop
    return (docs[0], hashes[0]) if len(docs) == 1 else (np.concatenate(docs), np.concatenate(hashes))


def _part_end(data: np.ndarray, start: int) -> int:
    """The end of a part of CHUNK bytes, or of the word that goes on there."""
    stop = start + CHUNK
    while stop < len(data):
        ends = np.flatnonzero(~_WORD[data[stop - 1 : stop - 1 + CHUNK]])
        if len(ends):
            return stop + int(ends[0])
        stop += CHUNK
    return len(data)


def _hashed(data: np.ndarray, offsets: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of ``data``; texts begin at ``offsets``."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    is_word = _WORD[data]
    before, after = np.concatenate([[False], is_word[:-1]]), np.concatenate([is_word[1:], [False]])
    starts, ends = np.flatnonzero(is_word & (~before | begins[:-1])), np.flatnonzero(is_word & (~after | begins[1:])) + 1
    if first:
        longer = ends - starts > first
        starts = starts[longer]
        ends = starts + first
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingled(doc: np.ndarray, hashes: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of ``width`` words; a shorter text that has words gives one run of all of them."""
    sizes = np.bincount(doc, minlength=n)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    full = len(hashes) - width + 1
    rows, out = [], []
    if full > 0:
        acc = np.zeros(full, np.uint64)
        for j in range(width):
            acc = mix(acc * _STEP + hashes[j : j + full])
        whole = doc[:full] == doc[width - 1 :]
        rows.append(doc[:full][whole])
        out.append(acc[whole])
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        acc = np.full(len(short), _U(7), np.uint64)
        for j in range(width - 1):
            there = j < sizes[short]
            acc[there] = mix(acc[there] * _STEP + hashes[starts[short[there]] + j])
        rows.append(short)
        out.append(mix(acc + sizes[short].astype(np.uint64)))
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def multisets(doc: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, count): how often each row has each item."""
    if len(doc) and doc.min() == doc.max():  # one text: nothing else to keep apart
        items = np.sort(items)
        new = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        return np.full(len(new), doc[0]), items[new], np.diff(np.append(new, len(items)))
    key = mix(items + doc.astype(np.uint64) * _STEP)
    order = np.argsort(key)
    key, doc, items = key[order], doc[order], items[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return doc[new], items[new], np.diff(np.concatenate([new, [len(key)]]))


def digests(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's sequence of words, and 0 for rows without any."""
    sizes = np.bincount(doc, minlength=n)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    out = []
    for seed in (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place + seed)))])
        ends = np.cumsum(sizes)
        out.append(np.where(sizes > 0, mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)), _U(0)))
    return out[0], out[1]
