"""Benchmark decontamination by SimHash windows and a multi-index Hamming search.

Every benchmark item is a window of words; documents are read in windows of the
same numbers of words. A window's fingerprint is the SimHash of its word
shingles, weighted by how often each occurs in it. The fingerprints of the items
are indexed by blocks: two fingerprints that differ in at most ``RADIUS`` bits
differ in at most ``RADIUS // BLOCKS`` bits of some block, so each block's table
holds an item under all values that near, and no fingerprint within the radius
is missed. Candidates are verified exactly: the weighted Jaccard similarity of
the shingles (sum of the smaller counts over sum of the larger) must be
``SIMILARITY`` or more. A text of fewer words than an item is one window for
it, where it has enough words for that similarity.

Windows are only fingerprinted where they can pass: a similarity over 0 needs a
shared shingle, so windows that hold no shingle of any item are skipped, which
loses nothing. Items are a stated query set against all rows: they go to the
tasks in blocks of at most ``ITEMS`` items, so what is broadcast is bounded, and
a larger benchmark means more passes over the documents. Nothing is shuffled
but the found rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import mapped, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 the expected distance is about 10 of 64 bits, the standard deviation 3.
RADIUS = 19
BLOCKS = 5
#: Items in one broadcast index, and characters of items at most.
ITEMS = 5_000
ITEM_CHARS = 4_000_000
#: Windows whose bit sums are held at a time.
WINDOWS = 1 << 15
#: Windows looked up in the index at a time.
SEARCHED = 4096
#: Bytes of texts that are looked through for shared shingles at a time.
TOGETHER = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, ``n`` at least; kept in a worker."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            p = np.full(2 * n, base)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a text: white space cut, A-Z lower-cased, joined by single spaces."""

    def __init__(self, body: bytes) -> None:
        self.joined = b" ".join(body.lower().split())
        data = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.begin = np.concatenate([[0], gaps + 1]) if len(data) else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(data)]]) if len(data) else np.zeros(0, np.int64)
        self.data = data

    def __len__(self) -> int:
        return len(self.begin)

    def shingle_hashes(self, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words, from prefix sums over the bytes."""
        if len(self) < size:
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:len(self.data)], out=sums[1:])
        begin, end = self.begin[:len(self) - size + 1], self.end[size - 1:]
        return _mix((sums[end] - sums[begin]) * inverse[begin])

    def shingles(self, at: int, words: int, size: int) -> Counter:
        """The shingles of the window of ``words`` words at word ``at``, with counts."""
        return Counter(self.joined[b:e] for b, e in zip(
            self.begin[at:at + words - size + 1].tolist(), self.end[at + size - 1:at + words].tolist()))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the first 0, 1, 2, ... hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def window_fingerprints(sums: np.ndarray, starts: np.ndarray, shingles: int) -> np.ndarray:
    """SimHash of the windows of ``shingles`` shingles that begin at ``starts``."""
    ones = sums[starts + shingles] - sums[starts]
    return np.packbits(2 * ones > shingles, axis=1, bitorder="little").view("<u8")[:, 0]


class Index:
    """Fingerprints of items, by the values near each of their blocks."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int = SHINGLE, radius: int = RADIUS,
                 blocks: int = BLOCKS) -> None:
        self.radius, self.blocks = radius, blocks
        self.items = []          # (item_id, words, shingle size, shingles with counts)
        prints, every = [], {}
        for item_id, body in items:
            w = Words(body)
            if not len(w):
                continue
            size = min(shingle, len(w))
            h = w.shingle_hashes(size)
            prints.append(window_fingerprints(bit_sums(h), np.zeros(1, np.int64), len(h))[0])
            every.setdefault(size, []).append(h)
            self.items.append((item_id, len(w), size, w.shingles(0, len(w), size)))
        self.prints = np.array(prints, np.uint64)
        self.hashes = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        self.length = np.array([x[1] for x in self.items], np.int64)
        self.lengths: dict[int, list[int]] = {}
        for n, k in sorted({(x[1], x[2]) for x in self.items}):
            self.lengths.setdefault(k, []).append(n)
        self.cuts = [(int(b[0]), len(b)) for b in np.array_split(np.arange(64), blocks)]
        self.tables = [self._table(*cut) for cut in self.cuts]

    def _table(self, shift: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Items in order of block value, and where each value's items begin."""
        own = (self.prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        flips = [sum(1 << b for b in f) for k in range(self.radius // self.blocks + 1)
                 for f in combinations(range(width), k)]
        near = (own[:, None] ^ np.array(flips, np.uint64)[None, :]).astype(np.int64)
        item = np.repeat(np.arange(len(own), dtype=np.int32), len(flips))
        order = np.argsort(near.ravel(), kind="stable")
        return item[order], np.searchsorted(near.ravel()[order], np.arange((1 << width) + 1))

    def candidates(self, prints: np.ndarray, words: np.ndarray, longer: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, of as many words each or with ``longer`` items."""
        found = []
        for (shift, width), (items, first) in zip(self.cuts, self.tables):
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            n = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), n)
            item = items[np.arange(n.sum()) + np.repeat(first[value] - (np.cumsum(n) - n), n)]
            length = self.length[item]
            fits = np.flatnonzero(length > words[window] if longer else length == words[window])
            window, item = window[fits], item[fits]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[near] * len(self.items) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)

    def _verify(self, w: Words, starts: np.ndarray, prints: np.ndarray, words: np.ndarray, size: int,
                similarity: float, out: dict, longer: bool = False) -> None:
        """Search windows and add what passes the exact check to ``out``."""
        counted: dict[tuple[int, int], Counter] = {}
        for k, i in zip(*(x.tolist() for x in self.candidates(prints, words, longer))):
            window = int(starts[k]), int(words[k])
            if window not in counted:
                counted[window] = w.shingles(*window, size)
            item_id, _, _, want = self.items[i]
            both = (counted[window] & want).total()
            like = both / (window[1] - size + 1 + want.total() - both)
            if like >= similarity:
                best, first, n = out.get(item_id, (0.0, 0, 0))
                better = like > best or (like == best and window[0] < first)
                out[item_id] = (like, window[0], n + 1) if better else (best, first, n + 1)

    def suspects(self, bodies: list[bytes]) -> np.ndarray:
        """Positions of the texts that share a shingle with an item; the others can't pass.

        The texts are looked through together, up to ``TOGETHER`` bytes at a time.
        """
        texts = [b" ".join(b.lower().split()) for b in bodies]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        found, at = [], np.flatnonzero(size)
        piece = np.cumsum(size[at]) // TOGETHER
        for part in np.split(at, np.flatnonzero(np.diff(piece)) + 1) if len(at) and self.items else []:
            w = Words(b" ".join(texts[i] for i in part))
            text = np.repeat(part, [texts[i].count(b" ") + 1 for i in part])
            for size, known in self.hashes.items():
                h = w.shingle_hashes(size)
                if not len(h):
                    continue
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                hit = np.flatnonzero(hit & (text[:len(h)] == text[size - 1:]))
                found.append(text[hit])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def leaks(self, body: bytes, similarity: float) -> dict[int, tuple[float, int, int]]:
        """Items found in a text: item_id to (best similarity, its first word, windows found)."""
        w, out = Words(body), {}
        for size, lengths in self.lengths.items() if len(w) else ():
            known, hashes = self.hashes[size], w.shingle_hashes(size)
            if not len(hashes):
                continue
            shared = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
            longest = lengths[-1] - size + 1
            beyond = next((n for n in lengths if n > len(w)), None)     # the text is one window for longer items
            if beyond and shared.any() and len(hashes) / (beyond - size + 1) >= similarity:
                start = np.zeros(1, np.int64)
                self._verify(w, start, window_fingerprints(bit_sums(hashes), start, len(hashes)),
                             np.array([len(w)]), size, similarity, out, longer=True)
            for low in range(0, len(hashes), WINDOWS):   # windows that begin in this part
                part = hashes[low:low + WINDOWS + longest]
                before = np.concatenate([[0], np.cumsum(shared[low:low + WINDOWS + longest])])
                if not before[-1]:
                    continue
                sums, found = bit_sums(part), []
                for words in lengths:
                    n = words - size + 1
                    starts = np.flatnonzero(before[n:] > before[:-n]) if len(part) >= n else np.zeros(0, np.int64)
                    starts = starts[starts < WINDOWS]
                    found.append((starts, window_fingerprints(sums, starts, n), np.full(len(starts), words)))
                starts, prints, words = map(np.concatenate, zip(*found))
                for k in range(0, len(starts), SEARCHED):
                    own = slice(k, k + SEARCHED)
                    self._verify(w, starts[own] + low, prints[own], words[own], size, similarity, out)
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, read through the driver one block at a time."""
    block, chars = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body")).distinct()
    for r in rows.toLocalIterator():
        block.append((r["item_id"], bytes(r["body"])))
        chars += len(r["body"])
        if len(block) >= ITEMS or chars >= ITEM_CHARS:
            yield block
            block, chars = [], 0
    yield block


LEAKS = "doc_id long, item_id long, similarity double, first_word long, windows long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Benchmark items found in documents, one row for each document and item.

    Returns doc_id, item_id, the similarity of the best window, its first word,
    and how many windows passed. Null and empty texts or items have no window.
    Items of fewer than five words are one shingle and must occur whole. A text
    of fewer words than an item is compared with it as a whole. Repeated rows
    give repeated rows; empty tables give no rows.
    """
    def search(index) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = index.value
            for b in batches:
                at = ix.suspects(list(b["body"]))
                rows = [(d, None if i is None else str(i), *x) for d, body in zip(b["doc_id"].iloc[at], b["body"].iloc[at])
                        for i, x in ix.leaks(body, similarity).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "first_word", "windows"])
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).transform(
            mapped, each, LEAKS, ("doc_id", "item_id"))

    sc = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionAll, [search(sc.broadcast(Index(b))) for b in _blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    sc = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        docs = docs.where(~_leaks(sc.broadcast(Index(block)), similarity)(text_bytes()))
    return docs


def _leaks(index, similarity: float):
    @F.pandas_udf("boolean")
    def leaks(bodies: pd.Series) -> pd.Series:
        ix = index.value
        out = np.zeros(len(bodies), bool)
        for i in ix.suspects(list(bodies)):
            out[i] = bool(ix.leaks(bodies.iloc[i], similarity))
        return pd.Series(out)
    return leaks
