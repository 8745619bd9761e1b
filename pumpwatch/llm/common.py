"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker at a time: documents are a few KB each, with
#: some of 100 KB and more, and two workers share an executor's memory.
ARROW_ROWS = "1000"
#: And so many bytes at most, but for a single row of more.
ARROW_BYTES = "4m"

#: Words are maximal runs of bytes other than ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master (tests, a laptop) gets a folder of its
    own; a cluster without the setting is an error, as a machine-local folder
    would be lost with its machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file:///tmp/pumpwatch-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; Spark's writers create it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(text: str = "text"):
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")),
                  F.lit(mod))


def mapped(rows: DataFrame, each, schema: str, exact: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``mapInPandas`` whose whole numbers ``exact`` travel as text: pandas would turn them into
    floating point numbers, not exact beyond 2**53, where one in a batch is null."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    sent = rows.withColumns({c: F.col(c).cast("string") for c in exact if c in rows.columns})
    text = T.StructType([T.StructField(c, T.StringType() if c in exact else k) for c, k in kinds.items()])
    return sent.mapInPandas(each, text).select(*[F.col(c).cast(k) if c in exact else F.col(c) for c, k in kinds.items()])


def in_blocks(docs: DataFrame, block_bytes: int, *more) -> tuple[DataFrame, int]:
    """The documents dealt over blocks of about ``block_bytes`` bytes of text: (doc_id, body, block, ...),
    and how many blocks.

    ``body`` is the text's UTF-8 bytes, packed (``unpacked`` gives them back), so
    that less is shuffled. The number of blocks follows the size of the table.
    A block is named by the document's id and text, so a task that is run again
    gets the same documents, and texts without an id or with one id are spread.
    The id is text, as ``mapped`` sends it.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b["body"] = [z.compress(x) for x in b["body"]]
            yield b
    dealt = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_bytes().alias("body"),
                        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(blocks)).alias("block"), *more)
    return dealt.mapInPandas(pack, dealt.schema), blocks


def unpacked(bodies: Iterable[bytes]) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in bodies]
