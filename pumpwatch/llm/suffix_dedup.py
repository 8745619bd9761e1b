"""Removal of repeated passages with a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier
(smaller doc_id, or the same document and an earlier start). The steps, each of
them spread over blocks of documents of a bounded size:

1. Sampling. Of the strings of ``ANCHOR`` bytes in each string of ``length``
   bytes, the one with the smallest hash is its anchor. Equal strings have
   their anchors at the same place, so it is enough to compare what surrounds
   equal anchors; about 3 of 100 positions are anchors. Anchors found once in
   all the corpus are dropped: only hash and block are shuffled for that, a row
   for each hash in a block.
2. Contexts. A repeated anchor goes on with the bytes of the strings that it
   stands for. Equal contexts in a block are settled there: all but the first
   are covered. Anchors with more than ``HOT`` places send each string under a
   key of its own, dealt over ``SALTS`` parts by block: there is nothing to sort
   in such a group, its earliest place is found part by part, then over the
   parts, a row at a time. Groups that are sorted have ``HOT`` contexts at most.
3. Suffix sort. The suffixes that begin at the anchors, and the reversed ones
   that end there, are sorted by merging runs; two suffixes are compared by
   searching the length of their common extension by bisection over prefix
   polynomial hashes. Neighbours in the sorted order are then compared byte by
   byte; a group in which a hash lied is sorted by its bytes. Common extensions
   of neighbours give classes of equal extensions to either side, and so, for
   each string, whether it started earlier.
4. The covered runs come back to the documents' blocks, where they are joined
   and cut out.

The documents are shuffled once, packed, by block; Spark reuses that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import in_blocks, unpacked

LENGTH = 100
ANCHOR = 32
BLOCK_BYTES = 8 << 20
#: Bytes that are hashed at a time; positions in them fit in PLACE bits.
PLACE = 20
HOT = 2000
#: Parts of a string's places under a hot anchor: one row a block comes in, one a part goes on.
SALTS = 256
#: Contexts that are sorted together; a group of equal anchors is never cut.
TOGETHER = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for PLACE bits of positions."""
    if not _POWERS:
        for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            p = np.full((1 << PLACE) + 1, base)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[0][:len(data)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of ``data``: hash, place, and the first and last string that each stands for.

    ``end`` is the end of each byte's document; strings don't cross it.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    size = min(ANCHOR, length)
    sums = prefix_hashes(data)
    h = _mix((sums[size:] - sums[:-size]) * _powers()[1][:len(data) - size + 1])
    places = np.uint64((1 << PLACE) - 1)
    least = (h & ~places) | np.arange(len(h), dtype=np.uint64)
    have, want = 1, length - size + 1
    while have < want:      # smallest of 1, 2, 4, ... neighbours
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.flatnonzero(np.arange(length, len(data) + 1) <= end[:len(data) - length + 1])
    if not len(start):
        return none.astype(np.uint64), none, none, none
    place = (least[start] & places).astype(np.int64)
    # the next string has another anchor, or is that of another document
    last = np.append(np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)), len(place) - 1)
    first = np.append(0, last[:-1] + 1)
    return h[place[last]], place[last], start[first], start[last]


def _pieces(bodies: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts strung together, at most 2**PLACE bytes at a time: (bytes, end of each byte's
    document, document of each byte, place in it of each byte). A string is in one piece only."""
    room = 1 << PLACE

    def strung(held: list) -> tuple:
        size = np.array([len(x[2]) for x in held])
        ends = np.cumsum(size)
        return (np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.repeat(ends, size),
                np.repeat([x[0] for x in held], size),
                np.arange(ends[-1]) - np.repeat(ends - size - np.array([x[1] for x in held]), size))
    held, filled = [], 0
    for d, body in enumerate(bodies):
        at = 0
        while len(body) - at >= length:
            part = body[at:at + room]
            if filled + len(part) > room:
                yield strung(held)
                held, filled = [], 0
            held.append((d, at, part))
            filled += len(part)
            at += len(part) - length + 1
    if held:
        yield strung(held)


class Block:
    """The different documents of a block, in order of their ids."""

    def __init__(self, docs: pd.DataFrame) -> None:
        docs = docs.drop_duplicates(["order", "copy"]).sort_values(["order", "copy"])
        self.order, self.copy = docs["order"].to_numpy(), docs["copy"].to_numpy()
        self.bodies = unpacked(docs["body"])


def _anchor_rows(length: int):
    def each(docs: pd.DataFrame) -> pd.DataFrame:
        found = [anchors(data, end, length)[0] for data, end, _, _ in _pieces(Block(docs).bodies, length)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pd.DataFrame({"hash": h.view(np.int64), "block": docs["block"].iloc[0], "n": n})
    return each


def _joined(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to ``rows`` rows or more, but for the last; none is empty."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(b):
            held.append(b)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


class Groups:
    """Rows sorted by key, handed on when there are enough, no group of equal keys cut."""

    def __init__(self, rows: int) -> None:
        self.rows, self.held = rows, []

    def add(self, b: pd.DataFrame) -> pd.DataFrame:
        self.held.append(b)
        if sum(map(len, self.held)) < self.rows:
            return b.iloc[:0]
        all_ = pd.concat(self.held, ignore_index=True)
        cut = int(np.searchsorted(all_["key"].to_numpy(), all_["key"].iloc[-1]))
        self.held = [all_.iloc[cut:]]
        return all_.iloc[:cut]

    def rest(self) -> pd.DataFrame:
        return pd.concat(self.held, ignore_index=True)


def _repeated(most: int):
    """Of rows sorted by hash, those of hashes in several places, and whether in over ``most``.

    A hash is hot as soon as ``most`` places are passed; its rows then go on as
    they come, so at most that many are held back for the next ones.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hot = None, None
        for b in _joined(batches, 100_000):
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            h = b["hash"].to_numpy()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(b["n"].to_numpy(), first)
            if h[0] == hot:
                total[0] += most
            told = len(h) if total[-1] > most else int(first[-1])
            n = np.repeat(total, np.diff(np.append(first, len(h))))
            hot, held = (h[-1] if told == len(h) else None), b.iloc[told:]
            yield pd.DataFrame({"hash": h, "block": b["block"], "hot": n > most})[(n > 1) & (np.arange(len(h)) < told)]
        if held is not None and held["n"].sum() > 1:
            yield pd.DataFrame({"hash": held["hash"], "block": held["block"], "hot": False})
    return each


CONTEXT = ("key long, salt int, block long, order long, copy long, place long, low int, high int, "
           "context binary")


def _contexts(length: int, salts: int):
    """Cogrouped function: a block's documents and repeated anchors to contexts.

    A row with a context: an anchor at ``place``, strings that begin ``low`` to
    ``high`` bytes before it; the context begins ``high`` bytes before it. Without
    one: a covered run from ``place`` to ``key``. Strings of hot anchors have a salt.
    """
    def each(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows, seen = [], {}
        if len(docs) and len(wanted):
            block, number = Block(docs), int(docs["block"].iloc[0])
            wanted = wanted.sort_values("hash")
            known, hot = wanted["hash"].to_numpy(), wanted["hot"].to_numpy()
            for data, end, doc, own in _pieces(block.bodies, length):
                h, place, first, last = anchors(data, end, length)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                keep = np.flatnonzero(known[at] == h)
                raw, cover = data.tobytes(), []
                for k, p, lo, hi, is_hot in zip(h[keep].tolist(), place[keep].tolist(), first[keep].tolist(),
                                                last[keep].tolist(), hot[at[keep]].tolist()):
                    context, d, s = raw[lo:hi + length], int(doc[p]), int(own[lo])
                    if not _is_first(seen, (k, p - lo, context), (int(block.order[d]), s)):
                        cover.append((d, s, s + hi - lo + length))
                        continue
                    for a, b in ((w, w) for w in range(lo, hi + 1)) if is_hot else ((lo, hi),):
                        part, s = raw[a:b + length], int(own[a])
                        if is_hot:
                            key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                            if not _is_first(seen, (key, 0, part), (int(block.order[d]), s)):
                                cover.append((d, s, s + length))
                                continue
                            rows.append((key, number % salts, number, int(block.order[d]), int(block.copy[d]), s, 0, 0, part))
                        else:
                            rows.append((k, None, number, int(block.order[d]), int(block.copy[d]), int(own[p]), p - b, p - a, part))
                for d, s, e in _merged(cover):
                    rows.append((e, None, number, int(block.order[d]), int(block.copy[d]), s, None, None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")]).astype(
            {"salt": "Int32", "low": "Int32", "high": "Int32"})
    return each


def _is_first(seen: dict, what: tuple, at: tuple) -> bool:
    """Whether no earlier place of ``what`` was seen; the same place counts as first."""
    return seen.setdefault(what, at) >= at


def _merged(runs: list[tuple[int, int, int]]) -> list[list[int]]:
    """Runs (document, begin, end) joined where they touch."""
    out: list[list[int]] = []
    for d, s, e in sorted(runs):
        if out and out[-1][0] == d and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([d, s, e])
    return out


class Suffixes:
    """Suffixes of a byte array, compared by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.data, self.begin, self.size = np.append(data, np.zeros(1, np.uint8)), begin, size
        self.sums = prefix_hashes(data)
        self.inverse = _powers()[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by bisection."""
        a, b = self.begin[x], self.begin[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        inv_a, inv_b, sum_a, sum_b = self.inverse[a], self.inverse[b], self.sums[a], self.sums[b]
        while (low < high).any():
            half = (low + high + 1) // 2
            same = (self.sums[a + half] - sum_a) * inv_a == (self.sums[b + half] - sum_b) * inv_b
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal ones in order of their numbers."""
        n = self.common(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        smaller = self.data[self.begin[x] + n] < self.data[self.begin[y] + n]
        return np.where(end_x | end_y, (end_x & ~end_y) | (end_x & end_y & (x < y)), smaller)

    def sort(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Suffix numbers in sorted order within groups (begin and size of each), by mergesort.

        All runs of a width are merged at once: the place of a suffix in the
        merged run is its place in its own run plus its rank in the other.
        """
        order = np.arange(int(size.sum()))
        group = np.repeat(np.arange(len(size)), size)
        low, top = first[group], first[group] + size[group]
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(size[group] > width)
            local = at - low[at]
            begin = low[at] + local // (2 * width) * (2 * width)
            middle, end = np.minimum(begin + width, top[at]), np.minimum(begin + 2 * width, top[at])
            left = at < middle
            lo, hi = np.where(left, middle, begin), np.where(left, end, middle)
            other = lo.copy()
            own = order[at]
            todo = np.flatnonzero(lo < hi)
            while len(todo):    # rank in the other run, by bisection
                mid = (lo[todo] + hi[todo]) // 2
                less = self.before(order[mid], own[todo])
                lo[todo] = np.where(less, mid + 1, lo[todo])
                hi[todo] = np.where(less, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            place = begin + (at - np.where(left, begin, middle)) + (lo - other)
            order[place] = own
            width *= 2
        return order

    def classes(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffix numbers, and how far each extends in common with the one before it
        (-1 for the first of a group), both checked byte by byte."""
        order = self.sort(first, size)
        head = np.zeros(len(order), bool)
        head[first] = True
        x, y = order[:-1], order[1:]
        n = self.common(x, y)
        wrong = np.zeros(len(x), bool)
        for k in range(int(n.max(initial=0))):
            at = np.flatnonzero(n > k)
            wrong[at] |= self.data[self.begin[x[at]] + k] != self.data[self.begin[y[at]] + k]
        ends = (n == self.size[x]) | (n == self.size[y])
        wrong |= ~ends & (self.data[self.begin[x] + n] >= self.data[self.begin[y] + n])
        wrong &= ~head[1:]
        common = np.append(-1, n)
        common[head] = -1
        group = np.repeat(np.arange(len(size)), size)
        for g in np.unique(group[1:][wrong]).tolist():   # a collision: this group by its bytes
            at = slice(int(first[g]), int(first[g] + size[g]))
            text = {int(i): self.data[self.begin[i]:self.begin[i] + self.size[i]].tobytes() for i in order[at]}
            order[at] = sorted(text, key=lambda i: (text[i], i))
            for k in range(at.start + 1, at.stop):
                a, b = text[int(order[k - 1])], text[int(order[k])]
                common[k] = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
        return order, common


def earlier(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of ``rows`` (sorted by key): how far before the anchor the first and the
    last of its strings begin that started earlier; (-1, -1) if none did."""
    size = rows["context"].map(len).to_numpy(np.int64)
    low, high = rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(rows["context"]), np.uint8)
    key = rows["key"].to_numpy()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    members = np.diff(np.append(first, len(key)))
    ahead = Suffixes(data, ends - size + high, size - high)
    back = Suffixes(data[::-1], len(data) - (ends - size + high), high)
    sorted_ = [s.classes(first, members) for s in (ahead, back)]
    rank = rows.groupby(["order", "place"], sort=True).ngroup().to_numpy()
    farthest, nearest = np.full(len(rows), -1), np.full(len(rows), -1)
    for i in range(int(low.min()), int(high.max()) + 1):
        at = np.flatnonzero((low <= i) & (i <= high))
        if len(at) < 2:
            continue
        part = []
        for (order, common), n in zip(sorted_, (length - i, i)):
            label = np.empty(len(order), np.int64)
            label[order] = np.cumsum(common < n)
            part.append(label[at])
        string = part[0] * (len(rows) + 1) + part[1]
        by = np.lexsort((rank[at], string))
        s, r = string[by], rank[at][by]
        new = np.append(True, s[1:] != s[:-1])
        least = r[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        late = at[by[r > least]]
        nearest[late] = np.where(nearest[late] < 0, i, nearest[late])
        farthest[late] = i
    return farthest, nearest


RUN = "key long, block long, order long, copy long, begin long, end long, context binary"


def _runs(length: int):
    """Contexts sorted by key, salt and place to covered runs of documents; and, with key and
    context, the strings of hot anchors that are the earliest of their part."""
    def cold(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        done = b["context"].isna()
        yield _run_rows(b[done], b["place"][done], b["key"][done])
        for part in _parts(b[~done]):
            far, near = earlier(part, length)
            hit = part[far >= 0]
            yield _run_rows(hit, hit["place"] - far[far >= 0], hit["place"] - near[far >= 0] + length)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, groups = Firsts(), Groups(TOGETHER)
        for b in batches:
            salted = b["salt"].notna()
            hot = b[salted]
            if len(hot):
                out = _run_rows(hot, hot["place"], hot["place"] + length)
                late = firsts.covered(zip(hot["key"], hot["salt"]), hot["context"], hot["order"], hot["place"])
                out["key"], out["context"] = hot["key"].where(~late, hot["block"]), hot["context"].mask(late, None)
                yield out
            ready = groups.add(b[~salted])
            if len(ready):
                yield from cold(ready)
        if groups.held:
            yield from cold(groups.rest())
    return each


def _run_rows(rows: pd.DataFrame, begin: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Settled runs; the key is the block, where they are wanted."""
    return pd.DataFrame({"key": rows["block"], "block": rows["block"], "order": rows["order"], "copy": rows["copy"],
                         "begin": begin, "end": end, "context": None})


class Firsts:
    """The earliest place of each string, of rows sorted by key and place, read one at a time:
    only the strings of one key are held, one but where hashes are equal."""

    def __init__(self) -> None:
        self.key, self.seen = None, {}

    def covered(self, keys: Iterable, contexts: pd.Series, order: pd.Series, place: pd.Series) -> np.ndarray:
        """Which rows have an earlier one of the same string."""
        late = np.zeros(len(contexts), bool)
        for k, (key, context, at) in enumerate(zip(keys, contexts, zip(order, place))):
            if key != self.key:
                self.key, self.seen = key, {}
            late[k] = not _is_first(self.seen, context, at)
        return late


def _over_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, and the earliest strings of all parts sorted by key and place: all runs."""
    firsts = Firsts()
    for b in batches:
        told = b["context"].isna().to_numpy()
        rows = b[~told]
        told[~told] = firsts.covered(rows["key"], rows["context"], rows["order"], rows["begin"])
        yield b[told].drop(columns=["key", "context"])


def _parts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Whole groups whose contexts fit in 2**PLACE bytes together, groups of one left out."""
    key = rows["key"].to_numpy()
    single = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    rows = rows[~single]
    if not len(rows):
        return
    key = rows["key"].to_numpy()
    size = rows["context"].map(len).to_numpy()
    first = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    total = np.append(0, np.cumsum(size))[first]
    at = 0
    while at < len(first) - 1:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << PLACE), side="right")) - 1)
        yield rows.iloc[first[at]:first[stop]]
        at = stop


KEPT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(docs: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    by = {k: list(zip(x["begin"].tolist(), x["end"].tolist())) for k, x in runs.groupby(["order", "copy"])}
    rows = []
    for doc_id, order, copy, packed in zip(docs["doc_id"], docs["order"], docs["copy"], docs["body"]):
        body = unpacked([packed])[0]
        gone = _merged([(0, s, e) for s, e in by.get((order, copy), ())])
        at, kept = 0, []
        for _, s, e in gone:
            kept.append(body[at:s])
            at = e
        kept.append(body[at:])
        rows.append((doc_id, len(body), sum(e - s for _, s, e in gone), len(gone),
                     hashlib.sha256(b"".join(kept)).hexdigest(), [[s, e] for _, s, e in gone]))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated passages of ``docs`` (doc_id, text), as UTF-8 bytes.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes) and spans, the removed runs as [begin,
    end). Null texts count as empty. A null doc_id comes before all others.
    Repeated rows are one document and get equal results; different texts under
    one doc_id have the same rank, the earlier start counts. An empty table
    gives no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    dealt, _ = in_blocks(docs, BLOCK_BYTES, F.coalesce(doc_id, F.lit(-1 << 63)).alias("order"),
                         F.xxhash64("text").alias("copy"))
    by_block = dealt.groupBy("block")
    rows = by_block.applyInPandas(_anchor_rows(length), "hash long, block long, n long")
    repeated = rows.repartition("hash").sortWithinPartitions("hash").mapInPandas(
        _repeated(HOT), "hash long, block long, hot boolean")
    contexts = by_block.cogroup(repeated.groupBy("block")).applyInPandas(_contexts(length, SALTS), CONTEXT)
    by_part = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt", "order", "place")
    found = by_part.mapInPandas(_runs(length), RUN)
    by_key = found.repartition("key").sortWithinPartitions("key", "order", "begin")
    runs = by_key.mapInPandas(_over_parts, "block long, order long, copy long, begin long, end long")
    kept = by_block.cogroup(runs.groupBy("block")).applyInPandas(_kept, f"{KEPT}, spans array<array<long>>")
    return kept.withColumn("doc_id", F.col("doc_id").cast("long"))
