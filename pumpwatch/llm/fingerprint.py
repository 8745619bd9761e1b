"""Document fingerprints by one-permutation MinHash, packed to low-order bits.

Each word shingle of a text is hashed once. The top bits of the hash name its
bin, the smallest hash of each bin is kept: one sort of the hashes brings the
bins together. An empty bin takes the value of a filled one, chosen by a random
order of the bins that belongs to the empty bin (optimal densification: each
filled bin is as likely, and independently for each empty bin). Of every bin
the ``BITS`` low-order bits are stored, one hexadecimal digit a bin.

Two bins agree by chance with probability 2**-BITS, so the likeness of two
fingerprints, an estimate of the Jaccard similarity of the shingle sets, is
(m - c) / (1 - c) with m the share of equal digits and c = 2**-BITS, at least 0.

DataFrame functions only. Arrays are worked on in place within a row, so
nothing is exploded and fingerprints need no shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pumpwatch.llm.common import WORD_SPLIT

SHINGLE = 5
BINS = 128
BITS = 4
#: Prime above the products' needs, for the order of bins that belongs to an empty bin.
PRIME = (1 << 31) - 1
#: Documents that stand together in one window, on average.
GROUP = 2048


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(h: Column) -> Column:
    """Bin of a signed hash: its top bits, in the order of the hashes."""
    top = BINS.bit_length() - 1
    return (F.shiftright(h, 64 - top) + BINS // 2).cast("int")


def _shingle_hashes(words: Column) -> Column:
    """A hash of each run of SHINGLE words (of the whole sequence if it is shorter)."""
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))).when(
        n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _spread(firsts: Column) -> Column:
    """The smallest hash of each bin at the bin's place, null in empty bins."""
    nothing = F.lit(None).cast("bigint")
    placed = F.flatten(F.transform(firsts, lambda x, i: F.concat(
        F.array_repeat(nothing, _bin(x) - F.when(i > 0, _bin(F.get(firsts, i - 1))).otherwise(-1) - 1), F.array(x))))
    return F.concat(placed, F.array_repeat(nothing, BINS - F.size(placed)))


def _densified(bins: Column, firsts: Column) -> Column:
    """``bins`` with empty ones filled from the bin that comes first in their own order."""
    r = random.Random(BINS)
    factor = F.array(*[F.lit(r.randrange(1, PRIME)).cast("long") for _ in range(BINS)])

    def donor(a: Column) -> Column:
        best = F.array_min(F.transform(firsts, lambda x: ((_bin(x) + 1) * a % PRIME) * BINS + _bin(x)))
        return F.get(bins, (best % BINS).cast("int"))
    return F.when(F.size(firsts) == BINS, bins).otherwise(_let(factor, lambda factors: F.transform(
        bins, lambda x, j: F.when(x.isNotNull(), x).otherwise(_let(F.get(factors, j), donor)))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` as hexadecimal text.

    A text without words (also null) has the fingerprint of all zeros.
    """
    t = F.col(text)
    words = F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), WORD_SPLIT, -1), lambda w: w != "")
    # steps are columns of their own, so that each is worked out once
    steps = (df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
             .withColumn("_sorted", F.sort_array(_shingle_hashes(F.col("_words"))))
             .withColumn("_firsts", F.filter("_sorted", lambda x, i: (i == 0) | (
                 _bin(x) != _bin(F.get("_sorted", i - 1)))))
             .withColumn("_bins", _spread(F.col("_firsts"))))
    # hashed with the bin's number, so that a value kept by several bins counts as several
    digits = F.transform(_densified(F.col("_bins"), F.col("_firsts")), lambda x, j: F.substr(
        F.lit("0123456789abcdef"), F.xxhash64(x, j).bitwiseAND((1 << BITS) - 1).cast("int") + 1, F.lit(1)))
    made = F.when(F.size("_firsts") > 0, F.array_join(digits, "")).otherwise("0" * BINS)
    return steps.withColumn(name, made).drop("_words", "_sorted", "_firsts", "_bins")


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1, corrected for equal digits by chance."""
    chance = 2.0 ** -BITS
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(
        F.col(a), i, F.lit(1)) == F.substr(F.col(b), i, F.lit(1)))) / BINS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(docs: DataFrame, extend: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``extend(docs)`` (doc_id, text and the columns that extend adds) with ``next``: the same
    columns of the next row, in descending doc_id.

    After the last row comes the first; a null id counts as the smallest, equal
    ids come in the order of their texts. Ids are cut into groups of about GROUP
    documents, whose rows meet in one window; the last row of a group takes the
    first row of the next group, from a table with one row for each group.
    """
    ids = docs.select("doc_id")
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = min(1 << 62, max(1, (high - low + 1) * GROUP // n)) if n and low is not None else 1
    group = F.coalesce(F.floor(F.col("doc_id") / width), F.lit((low or 0) // width - 1))
    w = Window.partitionBy("_group").orderBy(F.desc_nulls_last("doc_id"), "text")
    heads = extend(docs.withColumn("_after", group).withColumn("_group", group).withColumn(
        "_n", F.row_number().over(w)).where("_n = 1").drop("_group", "_n"))
    down = Window.orderBy(F.desc("_group"))      # one row for each GROUP documents
    after = ids.select(group.alias("_group")).distinct().select(F.col("_group").alias("_of"), F.coalesce(
        F.lead("_group").over(down), F.first("_group").over(down)).alias("_after"))
    near = extend(docs)
    row = F.struct(*near.columns)
    tails = after.join(heads, "_after").select("_of", row.alias("_head"))
    near = near.withColumn("_group", group).withColumn("_next", F.lead(row).over(w))
    joined = near.join(tails, (F.col("_group") == F.col("_of")) & F.col("_next").isNull(), "left")
    return joined.withColumn("next", F.coalesce("_next", "_head")).drop("_group", "_of", "_next", "_head")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text is the text with its last half (rounded down, in code
    points) replaced by as many first code points of the next document's text,
    or all of them, in descending doc_id. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; repeated rows stay; an empty table gives none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pair = with_next(own, lambda df: with_fingerprint(df, "text", "fingerprint"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = pair.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint",
                         F.col("next.fingerprint").alias("_next"),
                         F.concat(F.substr("text", F.lit(1), F.char_length("text") - half),
                                  F.substr(F.col("next.text"), F.lit(1), half)).alias("_edited"))
    done = with_fingerprint(edited, "_edited", "edited_fingerprint")
    return done.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "_next").alias("near_next"))
