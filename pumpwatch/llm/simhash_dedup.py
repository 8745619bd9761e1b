"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify Hamming distance.

Equal texts have equal fingerprints, so everything after the fingerprints works
on distinct ones. 64 bits are cut into ``BLOCKS`` blocks; two fingerprints that
differ in at most ``radius`` bits agree on at least ``BLOCKS - radius`` blocks,
so each choice of that many blocks is a table of buckets, and a close pair
shares a bucket in one of them. Buckets are counted first (partial
aggregation): a bucket of one has no pair, a bucket of two is its own pair,
larger ones are solved in one task each, up to ``BUCKET`` members. Beyond that
a bucket is split again by the same principle over the bits that may still
differ; such a part holds at most 2**16 distinct fingerprints, and close ones
are found by flipping bits, not by comparing all pairs. A bucket gives the
edges of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import checkpoint, mapped, text_bytes
from pumpwatch.llm.components import connected_components

SEED = 42
BLOCKS = 6
BUCKET = 256


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text: bit set if set in over half the hashes.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    shingles are ``shingle`` words joined by a space, repeats included. Fewer
    words make one shingle; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row per row of docs."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b["body"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64)})
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("body")) \
        .transform(mapped, each, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """One mask for each choice of ``blocks - radius`` of the blocks ``bits`` are cut into."""
    cut = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(cut, blocks - radius)]


def _forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges of the links a-b between positions of ``values``."""
    root = np.arange(len(values))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[child], values[root[child]]


def _close_small(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of sorted rows, by comparing rows 1, 2, ... apart."""
    left, right, lag = [], [], 1
    at = np.arange(len(fp) - 1)
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        left.append(near)
        right.append(near + lag)
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _close_large(fp: np.ndarray, free: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in one group of distinct sorted fingerprints that differ in ``free`` bits only."""
    left, right = [], []
    for k in range(1, radius + 1):
        for flip in combinations(free, k):
            other = fp ^ np.uint64(sum(1 << b for b in flip))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            hit = np.flatnonzero((fp[at] == other) & (other > fp))
            left.append(hit)
            right.append(at[hit])
    return np.concatenate(left), np.concatenate(right)


def _solve(radius: int, masks: list[int], small: int):
    """mapInPandas function: sorted rows (bucket table, key, fp) to forest edges."""
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        bucket = (rows["tbl"].ne(rows["tbl"].shift()) | rows["key"].ne(rows["key"].shift()))
        group = np.cumsum(bucket.to_numpy())
        first = np.flatnonzero(bucket.to_numpy())
        size = np.diff(np.append(first, len(rows)))
        large = np.repeat(size > small, size)
        keep = np.flatnonzero(~large)
        a, b = _close_small(group[keep], fp[keep], radius)
        left, right = [keep[a]], [keep[b]]
        for s, n in zip(first[size > small], size[size > small]):
            part = fp[s:s + n]
            order = np.argsort(part)
            fixed = masks[int(rows["tbl"].iloc[s])]
            a, b = _close_large(part[order], [i for i in range(64) if not fixed >> i & 1], radius)
            left.append(s + order[a])
            right.append(s + order[b])
        u, v = _forest(fp, np.concatenate(left), np.concatenate(right))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b.iloc[-1]
            cut = int(np.flatnonzero(((b["tbl"] != last["tbl"]) | (b["key"] != last["key"])).to_numpy()).max(initial=-1)) + 1
            if cut:
                yield links(b.iloc[:cut].reset_index(drop=True))
            rest = b.iloc[cut:]
        if rest is not None and len(rest):
            yield links(rest.reset_index(drop=True))
    return each


def _bucketed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and table: (tbl, key, fp)."""
    keys = F.array(*[F.struct(F.lit(i).alias("tbl"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    return rows.select("fp", F.explode(keys).alias("k")).select("k.tbl", "k.key", "fp")


def _in_buckets(members: DataFrame, radius: int, masks: list[int], small: int) -> DataFrame:
    return members.repartition("tbl", "key").sortWithinPartitions("tbl", "key").mapInPandas(
        _solve(radius, masks, small), "u long, v long")


def close_edges(fps: DataFrame, radius: int = 3, blocks: int = BLOCKS,
                bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``fp`` at ``radius`` bits or fewer.

    The edges have the same components as all the close pairs.
    """
    masks = _masks(list(range(64)), blocks, radius)
    rows = _bucketed(fps, masks)
    counted = rows.groupBy("tbl", "key").agg(
        F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    counted = checkpoint(counted)
    pairs = counted.where("n = 2").where(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    members = rows.join(counted.where("n > 2").select("tbl", "key", "n"), ["tbl", "key"])
    small = _in_buckets(members.where(f"n <= {bucket}").select("tbl", "key", "fp"), radius, masks, bucket)
    edges = pairs.unionAll(small)
    if not counted.where(f"n > {bucket}").isEmpty():
        finer = [[fixed | m for m in _masks([b for b in range(64) if not fixed >> b & 1], blocks, radius)]
                 for fixed in masks]
        parts = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in finer]),
                             F.col("tbl") + 1)
        hot = members.where(f"n > {bucket}").select("tbl", "fp", F.posexplode(parts).alias("part", "mask")).select(
            (F.col("tbl") * len(finer[0]) + F.col("part")).alias("tbl"),
            F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        edges = edges.unionAll(_in_buckets(hot, radius, [m for row in finer for m in row], 4 * bucket))
    return edges


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints ``fp`` (with other columns) and the ``root`` fingerprint of each one's group."""
    star = connected_components(close_edges(prints.select("fp"), radius))
    return prints.join(star.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def components(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id): the smallest doc_id reachable over
    links of at most ``radius`` bits, the document itself included.

    Rows with a null doc_id are linked like others but never name a component,
    unless no row of it has an id (then component_id is null).
    """
    fps = checkpoint(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(least, radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): (doc_id, fp, component_id).

    A null or empty text has the fingerprint 0 and is linked like any other;
    other columns are ignored; an empty table gives no rows; repeated rows are
    kept.
    """
    return components(fingerprints(docs, shingle), radius)


def near_duplicates_removed(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one document of each group stays.

    Of each group stays the document with the smallest id, with all its columns;
    rows without an id come after all ids, and of unlike texts under one id that
    with the least hash stays. Of repeated rows (equal id and text) one stays.
    """
    key = [F.col("doc_id").cast("long"), F.md5(text_bytes())]
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b["body"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"], "hash": b["hash"], "fp": fps.view(np.int64)})
    # ids go through pandas as text: a null among them would turn them into floats
    prints = docs.select(key[0].cast("string").alias("id"), key[1].alias("hash"), text_bytes().alias("body")) \
        .mapInPandas(each, "id string, hash string, fp long").withColumn("id", F.col("id").cast("long"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    prints = checkpoint(prints.groupBy("fp").agg(first))
    kept = _rooted(prints, radius).groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias("_kept_id"), F.col("first.hash").alias("_kept_hash"))
    rows = docs.withColumns({"_row_id": key[0], "_row_hash": key[1]})
    stay = rows.join(kept, F.col("_row_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_hash") == F.col("_kept_hash")),
                     "left_semi")
    return stay.dropDuplicates(["_row_id", "_row_hash"]).drop("_row_id", "_row_hash")
