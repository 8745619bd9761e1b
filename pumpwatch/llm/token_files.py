"""Token counts of flat, unindexed token files by a separator scan.

A flat file is a run of little-endian unsigned integers; an end-of-document
identifier follows each document, nothing tells where documents begin. Files
are read in blocks. In each block one array comparison finds all separators;
the documents that end in their block are done. A document that is open at a
block's end is closed by the first separator of the later blocks: a scan over
one row a block (smallest separator place among all that follow) stitches the
boundaries, however many blocks a document spans.

``write_token_files`` makes such files from documents. There each document
begins with its id as a header of HEADER numbers in base RADIX, which is below
every reserved identifier, so the files carry all that is needed and no order
has to be kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pumpwatch.llm.common import text_bytes

HEADER, RADIX = 5, 50_000
#: Tokens of a block.
BLOCK = 1 << 18
#: Characters of ``pieces``.
PIECE = 1 << 16
#: White space that long is too much for the encoder's own split, which keeps a step a character on its stack.
BLANKS = re.compile(r"\s{65536}")
_ENCODINGS: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """A public rank file as an encoding, made once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut into pieces of about ``size`` characters, before a space if one is near.

    A piece may end inside a match of the split pattern, so pieces aren't encoded apart.
    """
    out, at = [], 0
    while len(text) - at > size:
        stop = text.rfind(" ", at + size // 2, at + size)
        stop = at + size if stop < 0 else stop
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def token_ids(text: str, enc, pattern: str) -> list[int]:
    """The tokens of a whole text of any length: those of each match of ``pattern``."""
    if not BLANKS.search(text):
        return enc.encode_ordinary(text)
    return [i for m in regex.finditer(pattern, text) for i in enc._encode_single_piece(m.group())]


def header(doc_id: int | None) -> list[int]:
    """The id as HEADER digits in base RADIX, shifted so that a null is all zeros."""
    value = 0 if doc_id is None or pd.isna(doc_id) else int(doc_id) + (1 << 63) + 1
    return [value // RADIX ** k % RADIX for k in range(HEADER)]


def write_token_files(docs: DataFrame, path: str, ranks: str, pattern: str, eod: int) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write flat files of 16-bit identifiers.

    Each partition makes a file, without a shuffle. A null text has no tokens.
    All 64-bit ids have a header.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks, pattern)
        for b in batches:
            out = []
            for doc_id, body in zip(b["doc_id"], b["body"]):
                ids = token_ids(body.decode("utf-8", "replace"), enc, pattern)
                out.append(np.array([*header(doc_id), *ids], "<u2").tobytes())
            yield pd.DataFrame({"tokens": out})
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_bytes().alias("body")) \
        .mapInPandas(each, "tokens binary")
    # the text writer puts a row's bytes as they are and the separator after them
    separator = np.array([eod], "<u2").tobytes().decode("latin-1")
    rows.select(F.col("tokens").cast("string")).write.mode("overwrite").option(
        "lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _scan(eod: int, kind: str, lead: int):
    """A row for each document that begins in a block, and one (``start`` null) for the block."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, block, size, content in zip(b["file"], b["block"], b["size"], b["content"]):
                width = np.dtype(kind).itemsize
                ids = np.frombuffer(content, kind, len(content) // width)
                n, base = min(BLOCK, len(ids)), block * BLOCK
                ends = np.flatnonzero(ids[:n] == eod)
                starts = np.append(0, ends + 1) if block == 0 else ends + 1
                stops = np.append(ends, -1) if block == 0 else np.append(ends[1:], -1)[:len(starts)]
                keep = starts + base < size // width      # nothing begins at the file's end
                starts, stops = starts[keep], stops[keep]
                yield pd.DataFrame({
                    "file": file, "block": block, "start": pd.Series([*(starts + base), None], dtype="Int64"),
                    "stop": pd.Series([*np.where(stops < 0, -1, stops + base), ends[0] + base if len(ends) else None],
                                      dtype="Int64").replace(-1, pd.NA),
                    "header": [*(ids[s:s + lead].astype(np.int64).tolist() for s in starts), None],
                    "tokens": size // width})
    return each


def read_blocks(spark: SparkSession, path: str, width: int, lead: int) -> DataFrame:
    """Flat files under ``path`` in blocks (file, block, size, content); a block's content goes on
    for ``lead`` tokens. Spark reads a file as a whole, so files are below 2 GB."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    step = BLOCK * width
    return files.select(
        F.col("path").alias("file"), F.col("length").alias("size"), "content",
        F.explode(F.sequence(F.lit(0), (F.floor((F.col("length") - 1) / step)).cast("int"))).alias("block")).select(
        "file", "block", "size", F.substr("content", F.col("block") * step + 1, F.lit(step + lead * width)).alias("content"))


def count_tokens(spark: SparkSession, path: str, eod: int, kind: str = "<u2", lead: int = 0) -> DataFrame:
    """Documents of the flat token files under ``path``: (file, start, n_tokens, header).

    ``start`` is the document's first token in its file, ``header`` its first
    ``lead`` tokens, which n_tokens doesn't count. Two separators in a row hold
    an empty document; tokens after the last separator are a document, too.
    """
    blocks = read_blocks(spark, path, np.dtype(kind).itemsize, lead)
    rows = blocks.mapInPandas(_scan(eod, kind, lead), "file string, block int, start long, stop long, "
                              "header array<long>, tokens long")
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)   # a row a block
    ends = rows.where("start IS NULL").select("file", "block", F.min("stop").over(later).alias("_stop"))
    documents = rows.where("start IS NOT NULL")
    closed = documents.where("stop IS NOT NULL").select("file", "start", "stop", "header")
    open_ = documents.where("stop IS NULL").join(ends, ["file", "block"]).select(
        "file", "start", F.coalesce("_stop", "tokens").alias("stop"), "header")
    return closed.unionAll(open_).select(
        "file", "start", (F.col("stop") - F.col("start") - lead).alias("n_tokens"), "header")


def header_id(column: str):
    """The id that a header stands for, null for all zeros."""
    value = F.lit(0).cast("decimal(25,0)")
    for k in range(HEADER, 0, -1):      # up to 25 digits, more than a long has
        value = (value * F.lit(RADIX) + F.element_at(column, k)).cast("decimal(25,0)")
    return F.when(value != 0, (value - F.lit(str((1 << 63) + 1)).cast("decimal(25,0)")).cast("long"))
