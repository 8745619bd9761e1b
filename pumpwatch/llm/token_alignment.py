"""Alignment of two tokenizers' tokens over the same text.

Every token covers a range of the text's bytes. All ranges of A and B are
sorted by start (``lexsort``) and the running maximum of their ends is taken
(``maximum.accumulate``); where a start reaches it, all ranges before have ended
and a new group begins. Inside a group each A token is paired with the B tokens
it overlaps. A pair whose ranges end together is a link.

Links are counted over the whole corpus. Documents are written as blocks of a
bounded number of links, a row each, in which a link is the rank of its pair in
the block's own list of pairs, most frequent first; such ranks pack well. Each
block sends its list with counts once, the counts are added up by pair, joined
back to (block, rank), and the blocks look their links up. So a pair that is
everywhere is a row a block and no task needs the table of all pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import configure, work_dir

#: Links of a block; a document with more is a block of its own.
BLOCK_LINKS = 1 << 20
#: Below this the classes of characters are the same in all versions of Unicode.
PLAIN = 0x230


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable character of byte-level vocabularies stands for."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(extra)): b for b in range(256)}


#: How byte-level vocabularies split a text into words (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """One tokenizer: ids of a text, the bytes of each id, and its texts for the digest."""

    def __init__(self, entries: dict[int, bytes]) -> None:
        self.size = max(entries) + 1
        self.bytes = [entries.get(i, b"") for i in range(self.size)]
        self.length = np.fromiter(map(len, self.bytes), np.int64, self.size)
        # the id followed by each of the three separators
        self.shown = [f"{i}{sep}" for i in range(self.size) for sep in ",|;"]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level file of the tokenizers library; the text gets a space before it.

    The file's ids rise with its merges, so they serve as ranks of tiktoken, which
    encodes four times as fast. Texts with a character from ``PLAIN`` on, where
    the two libraries may class characters differently, go to the file's own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.rules = Tokenizer.from_file(path)
        self.rules.encode_special_tokens = True
        self.rules.no_truncation()
        self.rules.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, special = byte_of_symbol(), {t["content"] for t in spec["added_tokens"]}
        super().__init__({i: t.encode() if t in special else bytes(map(byte.__getitem__, t))
                          for t, i in self.rules.get_vocab(with_added_tokens=True).items()})
        self.fast, self.odd = None, re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and all(x < y for x, y in zip(made, made[1:])):
            import tiktoken
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and not self.odd.search(text):
            return self.fast.encode_ordinary(" " + text)
        return self.rules.encode(" " + text, add_special_tokens=False).ids


class Pieces(Side):
    """A sentencepiece file; it adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.rules = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__({i: bytes([int(self.rules.id_to_piece(i)[3:5], 16)]) if self.rules.is_byte(i)
                          else self.rules.id_to_piece(i).replace("▁", " ").encode()
                          for i in range(self.rules.get_piece_size())})

    def encode(self, text: str) -> list[int]:
        return self.rules.encode(text, num_threads=1)


@lru_cache(1)
def sides(a: str, b: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once in each Python worker."""
    return ByteLevel(a), Pieces(b)


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, from where the tokens end."""
    end = np.concatenate([a_end, b_end])
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(end), np.int64)
    group[order[1:]] = np.cumsum(start[order][1:] >= reach[:-1])
    return group[:len(a_end)], group[len(a_end):]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that share a byte, as two arrays of positions."""
    a_start = np.append(0, a_end[:-1])
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_end, a_end, side="left")       # the B token that covers A's last byte
    size = last - first + 1
    left = np.repeat(np.arange(len(a_end)), size)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(size) - size - first, size)


def shown(a: Side, b: Side, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
    of_a = a_ids * 3 + last_a
    of_b = a.size * 3 + b_ids * 3 + 2 * last_b
    # an A token comes after the B tokens of earlier groups, a B token after the A tokens of its own
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    out[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, side="left")] = of_a
    out[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = of_b
    words = _words(a, b)
    return "".join(map(words.__getitem__, out.tolist()))[:-1]


_TABLE: list = [None, None, None]


def _words(a: Side, b: Side) -> list[str]:
    if _TABLE[0] is not a or _TABLE[1] is not b:
        _TABLE[:] = a, b, a.shown + b.shown
    return _TABLE[2]


class Aligned:
    """One text's tokens on both sides, their groups and links; no tokens where the bytes differ."""

    def __init__(self, text: str, a: Side, b: Side) -> None:
        a_ids, b_ids = (a.encode(text), b.encode(text)) if text else ([], [])
        want = (" " + text).encode()
        if a.joined(a_ids) != want or b.joined(b_ids) != want:
            a_ids, b_ids = [], []
        self.a, self.b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        self.n_groups, self.left, self.right, self.groups = 0, self.a, self.b, ""
        if a_ids:
            a_end, b_end = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
            a_group, b_group = coalesce(a_end, b_end)
            self.n_groups = int(a_group[-1]) + 1
            left, right = overlaps(a_end, b_end)
            link = a_end[left] == b_end[right]
            self.left, self.right = self.a[left[link]], self.b[right[link]]
            self.groups = shown(a, b, self.a, self.b, a_group, b_group)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits byte by byte, then compressed: the high bytes nearly vanish."""
    raw = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8")[:, 0]


#: A block: what is known of its documents, their links as ranks, and the pair and count of each rank.
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]))),
    ("ranks", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])
BLOCK_SQL = ("block long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, "
             "groups_sha256: string, groups: string>>, ranks binary, pairs binary, counts binary")


def _block(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    pair, at, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(pair), np.int64)
    rank[order] = np.arange(len(pair))
    names = [f.name for f in BLOCK.field("docs").type.value_type]
    return pa.RecordBatch.from_pylist([{
        "block": number, "docs": [dict(zip(names, r)) for r in rows], "ranks": _pack(rank[at]),
        "pairs": _pack(pair[order]), "counts": _pack(n[order])}], BLOCK)


def _align(paths: tuple[str, str], contents: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*paths)
        number, held, rows, links = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                got = Aligned(text.as_py() or "", a, b)
                if held + len(got.left) > BLOCK_LINKS and rows:
                    yield _block(number, rows, links)
                    number, held, rows, links = number + 1, 0, [], []
                held += len(got.left) + 1       # documents without links fill a block, too
                links.append(got.left * b.size + got.right)
                rows.append((doc_id.as_py(), len(got.a), len(got.b), got.n_groups, len(got.left),
                             hashlib.sha256(got.groups.encode()).hexdigest() if len(got.a) else "",
                             got.groups if contents else None))
        if rows:
            yield _block(number, rows, links)
    return each


PAIRS = pa.schema([("block", pa.int64()), ("rank", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The list of each block, a row for each pair."""
    for batch in batches:
        for block, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            pair = _unpack(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(np.arange(len(pair))),
                                              pa.array(pair), pa.array(_unpack(counts))], schema=PAIRS)


SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, groups string")


def _looked_up(blocks: pa.Table, back: pa.Table) -> pa.Table:
    out = []
    total, best = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64)
    rank = back["rank"].to_numpy()
    total[rank], best[rank] = back["total"].to_numpy(), back["best"].to_numpy()
    for docs, ranks in zip(blocks["docs"].to_pylist(), blocks["ranks"].to_pylist()):
        ranks = _unpack(ranks)
        # sums over the links of each document, also where it has none
        stop = np.cumsum([d["n_links"] for d in docs])
        for column, of in (("n_best", best), ("count_sum", total)):
            upto = np.append(0, np.cumsum(of[ranks]))
            for d, x in zip(docs, upto[stop] - upto[np.append(0, stop[:-1])]):
                d[column] = int(x)
        out += docs
    return pa.Table.from_pylist(out, pa.schema(
        [(c, pa.string() if kind == "string" else pa.int64()) for c, kind in map(str.split, SCORED.split(", "))]))


def align_documents(docs: DataFrame, a: str, b: str, contents: bool = True, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Align the tokens of every text by the byte-level file ``a`` and the sentencepiece file ``b``.

    The paths are valid on every machine. Returns doc_id, how many tokens (n_a,
    n_b), groups and links the text has, n_best (links whose pair's corpus-wide
    count is the highest of its B id, ties included), count_sum (the counts of all
    links added up), groups_sha256 and groups (``a1,a2|b1;a3|b2,b3``; null with
    ``contents`` False). A text that is null, empty, or whose bytes a side doesn't
    give back (``b`` may normalise) has no tokens: zeros and ''. Repeated rows
    stay and count; other columns are ignored; an empty table gives no rows.
    """
    spark = configure(docs.sparkSession)
    vocabulary = sides(a, b)[1].size
    folder = work_dir(spark, "token-alignment")
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(_align((a, b), contents), BLOCK_SQL).write.parquet(folder)
    blocks = spark.read.schema(BLOCK_SQL).parquet(folder)
    pairs = blocks.select("block", "pairs", "counts").mapInArrow(_pairs, "block long, rank long, pair long, n long")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % vocabulary)
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))     # a row for each B id at most
    totals = totals.join(F.broadcast(highest) if vocabulary <= 1 << 20 else highest, "b") \
        .select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = pairs.select("block", "rank", "pair").join(totals, "pair").select("block", "rank", "total", "best")
    return blocks.select("block", "docs", "ranks").groupBy("block") \
        .cogroup(back.groupBy("block")).applyInArrow(_looked_up, SCORED)
