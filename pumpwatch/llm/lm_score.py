"""Language-model scores from a weighted backoff automaton.

The automaton has a state for each training word and one for the empty context.
From a word's state an arc for each word that followed it in training carries
the smoothed probability; the failure arc leads to the empty context at the
cost of the backoff weight. The empty context has an arc for each training word
and one for all others:

    P(w)     = c(w) / (N + V)                    and V / (N + V) for an unseen word
    P(w | h) = (1 - b) c(h w) / c(h) + b P(w)    seen arc
             = b P(w)                            failure arc, weight b

c, N and V are counts, tokens and distinct tokens of the training texts, b is
``BACKOFF``. Both are distributions over the V words and one symbol for all
others. A text is read once from left to right, the state carried from word to
word, the logs added up. Every arc of a word leads to that word's state, so the
states at all places of a text are known at once and it is read with array
operations.

The counts grow with the corpus, so no task holds them all. Documents are dealt
over blocks of a bounded size, and each block builds the part of the automaton
that its own texts can reach. Blocks send a row for each of their words; words
of several blocks come back with their counts over all. Pairs of words are
counted the same way, but only those whose words are both in several blocks:
others can't be anywhere else. Counts are aggregated within a block before they
are shuffled, so a word or pair in every text is sent once a block. What a block
sends is sorted by hash and packed, a row for each range of hashes; the number
of ranges follows the number of blocks, so ranges don't grow with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import crc_mod, in_blocks, unpacked

BACKOFF = 0.5
BLOCK_BYTES = 20 << 20
#: Ranges of hashes that counts meet in, at least; with more blocks as many as these.
PARTS = 256
#: Tokens that are looked up together.
READ = 1 << 19
#: The end of a text is counted as a token; no word is empty.
END = b""


class Block:
    """The tokens of a block's documents as numbers of its distinct words."""

    def __init__(self, docs: pd.DataFrame) -> None:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        end, parts = number[END], []
        for packed in docs["body"]:
            words = unpacked([packed])[0].lower().split()
            words.append(END)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.ids = np.concatenate(parts)
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number)).view(np.int64)
        self.train = np.repeat(~docs["held_out"].to_numpy(bool), self.size)
        self.place = np.flatnonzero(self.ids[:-1] != end).astype(np.int32)     # of the first word of each pair

    def counts(self) -> np.ndarray:
        """How often each word is in the training documents."""
        return np.bincount(self.ids[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of neighbours (number of the first times words plus that of the second),
        and their counts in training documents. Sorted in place, the training flag as last bit."""
        all_ = self.ids[self.place].astype(np.int64)
        all_ *= len(self.words)
        all_ += self.ids[self.place + 1]
        all_ <<= 1
        all_ |= self.train[self.place]
        all_.sort()
        pair = all_ >> 1
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        all_ &= 1
        return pair[first], np.add.reduceat(all_, first) if len(first) else np.zeros(0, np.int64)

    def pair_hash(self, pair: np.ndarray) -> np.ndarray:
        words = self.words.view(np.uint64)
        h = words[pair // len(words)] * np.uint64(0x9E3779B97F4A7C15) + words[pair % len(words)]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def given(self, back: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words over all blocks, and whether a word is in several."""
        counts, shared = self.counts(), np.zeros(len(self.words), bool)
        key, n = unpack(back)
        order = np.argsort(self.words)
        at = order[np.searchsorted(self.words, key, sorter=order)]
        counts[at], shared[at] = n, True
        return counts, shared


def _pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending unsigned keys and their counts: differences byte by byte, then compressed."""
    columns = [np.diff(key, prepend=np.uint64(0)).astype("<u8"), n.astype("<u8")]
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (signed) and counts of all ``rows`` (size, packed), in order."""
    z, keys, counts = zstandard.ZstdDecompressor(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, packed in zip(rows["size"], rows["packed"]):
        raw = np.frombuffer(z.decompress(packed), np.uint8).reshape(2, 8, int(size))
        difference, n = (np.ascontiguousarray(x.T).view("<u8")[:, 0] for x in raw)
        keys.append(np.cumsum(difference, dtype=np.uint64).view(np.int64))
        counts.append(n.astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


COUNTED = "part long, block long, size long, packed binary"
TOTAL = "block long, size long, packed binary, distinct long, tokens long"


def _rows(key: np.ndarray, n: np.ndarray, block: int, parts: int) -> pd.DataFrame:
    """A row for each range of hashes that a block has keys in."""
    key = key.view(np.uint64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    stop = np.append(first[1:], len(key))
    return pd.DataFrame({"part": part[first], "block": block, "size": stop - first,
                         "packed": [_pack(key[a:b], n[a:b]) for a, b in zip(first, stop)]})


def _word_rows(parts: int):
    def each(docs: pd.DataFrame) -> pd.DataFrame:
        b = Block(docs)
        return _rows(b.words, b.counts(), int(docs["block"].iloc[0]), parts)
    return each


def _pair_rows(parts: int):
    def each(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(back):
            return _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, parts)
        b = Block(docs)
        _, shared = b.given(back)
        pair, n = b.pairs()
        keep = shared[pair // len(shared)] & shared[pair % len(shared)]
        return _rows(b.pair_hash(pair[keep]), n[keep], int(docs["block"].iloc[0]), parts)
    return each


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the keys of several blocks, with their totals, to each of these blocks.

    A row without a block has how many keys have a total over 0, and the sum of all.
    """
    key, n = unpack(rows)
    order = np.argsort(key, kind="stable")
    key, n, owner = key[order], n[order], np.repeat(np.arange(len(rows)), rows["size"])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(n, first)
    several = np.flatnonzero(np.repeat(size > 1, size))
    several = several[np.argsort(owner[several], kind="stable")]
    key, sums, owner = key[several].view(np.uint64), np.repeat(total, size)[several], owner[several]
    out = []
    for i in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [i, i + 1])
        by = np.argsort(key[a:b])
        out.append((rows["block"].iloc[i], b - a, _pack(key[a:b][by], sums[a:b][by]), None, None))
    out.append((None, None, None, int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(out, columns=[c.split()[0] for c in TOTAL.split(", ")]).astype(
        dict.fromkeys(("block", "size", "distinct", "tokens"), "Int64"))


class Automaton:
    """The part of the backoff automaton that a block's texts can reach."""

    def __init__(self, counts: np.ndarray, pair: np.ndarray, pair_counts: np.ndarray, tokens: int,
                 distinct: int, backoff: float = BACKOFF) -> None:
        self.words = len(counts)
        total = max(1, tokens + distinct)
        self.empty = np.log10(np.where(counts > 0, counts, max(1, distinct)) / total)   # arcs of the empty context
        self.failure = np.where(counts > 0, np.log10(backoff), 0.0)   # a word never seen has no state of its own
        seen = pair_counts > 0
        self.arcs = pair[seen]
        context, word = self.arcs // self.words, self.arcs % self.words
        self.weight = np.log10((1 - backoff) * pair_counts[seen] / counts[context] + backoff * 10 ** self.empty[word])

    def read(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The log10 probability of each token; ``place`` are tokens whose state the next one is read in."""
        out = self.empty[ids]
        if not len(self.arcs):
            out[place + 1] += self.failure[ids[place]]
            return out
        for k in range(0, len(place), READ):
            part = place[k:k + READ]
            asked = ids[part].astype(np.int64) * self.words + ids[part + 1]
            at = np.minimum(np.searchsorted(self.arcs, asked), len(self.arcs) - 1)
            out[part + 1] = np.where(self.arcs[at] == asked, self.weight[at],
                                     self.failure[ids[part]] + self.empty[ids[part + 1]])
        return out


SCORED = ("doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _scores(backoff: float):
    def each(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])
        b = Block(docs)
        totals = back[back["kind"] == 2].iloc[0]
        distinct, tokens = int(totals["distinct"]), int(totals["tokens"])
        counts, _ = b.given(back[back["kind"] == 0])
        pair, n = b.pairs()
        hashes = b.pair_hash(pair)
        order = np.argsort(hashes)
        key, many = unpack(back[back["kind"] == 1])
        n[order[np.searchsorted(hashes, key, sorter=order)]] = many
        logs = Automaton(counts, pair, n, tokens, distinct, backoff).read(b.ids, b.place)
        first = np.cumsum(b.size) - b.size
        known = counts[b.ids]
        return pd.DataFrame({
            "doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held_out"].to_numpy(bool),
            "n_tokens": b.size, "n_known": np.add.reduceat(known > 0, first, dtype=np.int64),
            "train_tokens": tokens,
            "base_score": np.add.reduceat(np.log10((known + 1) / (tokens + distinct + 1)), first),
            "score": np.add.reduceat(logs, first)})
    return each


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, backoff: float = BACKOFF) -> DataFrame:
    """Scores of all texts of ``docs`` (doc_id, text) by a model of those whose crc32(doc_id as
    text) mod ``folds`` isn't ``held``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams) and score (the automaton), both log10 probabilities. A
    null or empty text is its end only. Repeated rows count, and are scored, as
    often as they occur. An empty table gives no rows; with no training text
    every token is the symbol for unseen words, with probability 1.
    Words and pairs are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    dealt, blocks = in_blocks(docs, BLOCK_BYTES, (crc_mod("doc_id", folds) == held).alias("held_out"))
    by_block = dealt.groupBy("block")
    parts = max(PARTS, blocks)
    word_totals = by_block.applyInPandas(_word_rows(parts), COUNTED).groupBy("part").applyInPandas(_totals, TOTAL)
    shared = word_totals.where("block IS NOT NULL").select("block", "size", "packed")
    pairs = by_block.cogroup(shared.groupBy("block")).applyInPandas(_pair_rows(parts), COUNTED)
    pair_totals = pairs.groupBy("part").applyInPandas(_totals, TOTAL).where("block IS NOT NULL")
    every = word_totals.where("block IS NULL").agg(F.struct(
        F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))).scalar()
    nothing = [F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("packed")]
    told = spark.range(blocks).select(F.col("id").alias("block"), F.lit(2).alias("kind"), *nothing, every.alias("t"))
    none = [F.lit(None).cast("long").alias(c) for c in ("distinct", "tokens")]
    back = (shared.select("block", F.lit(0).alias("kind"), "size", "packed", *none)
            .unionAll(pair_totals.select("block", F.lit(1).alias("kind"), "size", "packed", *none))
            .unionAll(told.select("block", "kind", "size", "packed", "t.distinct", "t.tokens")))
    scored = by_block.cogroup(back.groupBy("block")).applyInPandas(_scores(backoff), SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
