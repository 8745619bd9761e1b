"""Prefix tries of conversations as double arrays.

A conversation is the sequence of its turns, a turn being (role, text). Texts are
left behind at once: a turn goes on as an entry of 40 hex digits, the MD5 of
role and text and the text's length, and a conversation as its entries joined.
Equal conversations become one row with their number, their least id and the
hash of all their ids.

These sequences are dealt into shards by a prefix of ``depth`` turns, so all that
pass through a node at or below that depth are in one shard. The depth is 1 and
is doubled only for prefixes that more than ``SHARD`` sequences share. A task
takes shards of about ``SHARD`` sequences in all, numbers their turns densely and
packs their trie into BASE and CHECK arrays: the child of state s by turn t is
BASE[s] + t, if CHECK there is s. Walking all sequences through the arrays
together, one turn at a time, gives the counts at each node, and the levels from
the last to the first give what nodes add up over their subtrees.

Nodes above the depth of a shard may be in other shards, too. Tasks give their
parts of those, which are added up by node; sums over subtrees go on from these
few nodes to the nodes above them. Parents' ids go back to the tasks by (task,
node), so a node that all conversations share is a row for each task at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import checkpoint, configure, work_dir

#: Sequences of a shard, and of the shards that a task takes together on average.
SHARD = 4096
#: Characters of an entry: 32 of the MD5, 8 of the text's length.
ENTRY = 40
#: Items joined into one row, at most.
RUN = 1 << 15
#: Free slots tried for a node's children before they go behind all others.
TRIES = 64


def joined(rows: DataFrame, key: str, order: list[str], item: str, times: str, sep: str) -> DataFrame:
    """(key, at, run): the items of each key, in order, joined into rows of ``RUN`` items at most.

    Rows are range-partitioned by key and order, so a key with very many items is
    spread over tasks; ``at`` numbers its runs in their order.
    """
    kind = dict(rows.dtypes)[key]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, at, p = None, [], 0, 0
        for b in batches:
            out = []
            for k, p, x, n in zip(b["k"], b["p"], b["x"], b["n"]):
                while n:
                    if held and (k != now or len(held) >= RUN):
                        out.append((now, p << 33 | at, sep.join(held)))
                        held, at = [], at + 1
                    now, more = k, min(n, RUN - len(held))
                    held.extend([x] * more)
                    n -= more
            if out:
                yield pd.DataFrame(out, columns=["k", "at", "run"])
        if held:
            yield pd.DataFrame([(now, p << 33 | at, sep.join(held))], columns=["k", "at", "run"])

    by = [F.col(c) for c in [key, *order]]          # nulls come first
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        F.col(key).cast("string").alias("k"), F.spark_partition_id().cast("long").alias("p"),
        F.col(item).cast("string").alias("x"), F.col(times).cast("long").alias("n"))
    return dealt.mapInPandas(join, "k string, at long, run string").select(F.col("k").cast(kind).alias(key), "at", "run")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, packed): the entries of each conversation of ``turns`` (conv_id, turn, role, text).

    Ordered by turn, null first; a null role or text is empty; rows of one turn
    number are ordered by their hash, and repeated rows are repeated turns. Rows
    without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    entry = F.lower(F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)),
                             F.lpad(F.hex(F.char_length(text)), 8, "0")))
    said = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         entry.alias("entry"))
            .where("conv_id IS NOT NULL").groupBy("conv_id", "turn", "entry").agg(F.count("*").alias("times")))
    runs = joined(said, "conv_id", ["turn", "entry"], "entry", "times", "")
    in_order = F.array_sort(F.collect_list(F.struct("at", "run")))
    return runs.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda r: r["run"]), "").alias("packed"))


def with_shared_heads(own: DataFrame, every: int = 100, turns: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns are those of conversation c - c % ``every``, h being
    crc32(decimal c) % ``turns``; then come c's own turns after its first h."""
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("packed", 1, ENTRY * (turns - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int") * ENTRY
    return own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").select(
        "conv_id", F.concat(F.substring(F.coalesce("head", F.lit("")), F.lit(1), h),
                            F.col("packed").substr(h + 1, F.length("packed"))).alias("packed"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted runs of ids to one row for each key: the least id, how many, the SHA-256 of all, comma-joined."""
    now, least, n, state = None, 0, 0, None
    for b in batches:
        out = []
        for k, run in zip(b["key"], b["run"]):
            if k != now:
                if now is not None:
                    out.append((now, least, n, state.hexdigest()))
                now, least, n, state = k, int(run.split(",", 1)[0]), 0, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(run.encode())
            n += run.count(",") + 1
        if out:
            yield pd.DataFrame(out, columns=["key", "least", "n", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, least, n, state.hexdigest())], columns=["key", "least", "n", "ends"])


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(packed, least, n, ends) of each distinct sequence of ``seqs`` (conv_id, packed)."""
    keyed = seqs.select(F.md5("packed").alias("key"), "conv_id", "packed", F.lit(1).alias("one"))
    runs = joined(keyed.select("key", "conv_id", "one"), "key", ["conv_id"], "conv_id", "one", ",")
    ids = runs.repartition("key").sortWithinPartitions("key", "at").select("key", "run").mapInPandas(
        _digests, "key string, least long, n long, ends string")
    return keyed.groupBy("key").agg(F.min("packed").alias("packed")).join(ids, "key").select("packed", "least", "n", "ends")


def in_shards(distinct: DataFrame, shard: int) -> DataFrame:
    """The sequences with their shard's ``depth`` and the ``task`` that the shard is dealt to."""
    spark = distinct.sparkSession
    tasks = distinct.count() // shard + 1
    left, depth, done = distinct, 1, []
    while True:
        prefix = F.md5(F.substring("packed", 1, ENTRY * depth))
        left = left.withColumn("prefix", prefix)
        hot = checkpoint(left.groupBy("prefix").count().where(F.col("count") > shard).select("prefix"))
        rest = left if hot.isEmpty() else left.join(hot, "prefix", "left_anti")
        done.append(rest.select("packed", "least", "n", "ends", F.lit(depth).alias("depth"),
                                F.pmod(F.xxhash64("prefix"), F.lit(tasks)).alias("task")))
        if rest is left:
            break
        folder = work_dir(spark, "conversation-trie-hot")
        left.join(hot, "prefix", "left_semi").drop("prefix").write.parquet(folder)
        left, depth = spark.read.parquet(folder), 2 * depth
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


class DoubleArray:
    """A trie over dense codes: the child of state s by code c is ``base[s] + c`` if ``check`` there is s."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -2, np.int64)     # 0 is the root
        self.low = 1            # no free slot below

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        while True:
            free = np.flatnonzero(self.check[self.low:] == -1)[:n] + self.low
            if len(free) >= n:
                self.low = int(free[0])
                return free
            self._room(len(self.check) + n)

    def add(self, state: np.ndarray, code: np.ndarray) -> None:
        """Children of states, sorted by state and then code, each once."""
        if not len(state):
            return
        first = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        stop = np.append(first[1:], len(state))
        for lo, hi in zip(first[stop - first > 1].tolist(), stop[stop - first > 1].tolist()):
            codes = code[lo:hi]
            span = codes - codes[0]
            for slot in self._free(TRIES).tolist():
                self._room(slot + int(span[-1]) + 1)
                if (self.check[slot + span] == -1).all():
                    break
            else:
                slot = int(np.flatnonzero(self.check != -1)[-1]) + 1
                self._room(slot + int(span[-1]) + 1)
            self.base[state[lo]] = slot - codes[0]
            self.check[slot + span] = state[lo]
        alone = first[stop - first == 1]
        if len(alone):
            slots = self._free(len(alone))
            self.base[state[alone]] = slots - code[alone]
            self.check[slots] = state[alone]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one code each, -1 where there is no such arc."""
        to = self.base[state] + code
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == state), to, -1)


def dense(packed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense codes of all entries (new ones numbered in order of depth, then sequence), the text
    lengths of the codes, and where each sequence begins and how long it is."""
    size = np.fromiter((len(p) // ENTRY for p in packed), np.int64, len(packed))
    start = np.cumsum(size) - size
    raw = np.frombuffer(bytes.fromhex("".join(packed)), np.uint8).reshape(-1, ENTRY // 2)
    depth = np.arange(len(raw)) - np.repeat(start, size)
    by_depth = np.argsort(depth, kind="stable")
    entry, first, code = np.unique(np.ascontiguousarray(raw[by_depth]).view(f"V{ENTRY // 2}")[:, 0],
                                   return_index=True, return_inverse=True)
    rank = np.empty(len(entry), np.int64)
    rank[np.argsort(first)] = np.arange(len(entry))
    codes = np.empty(len(raw), np.int64)
    codes[by_depth] = rank[code]
    chars = np.empty(len(entry), np.int64)
    chars[rank] = np.ascontiguousarray(entry.view(np.uint8).reshape(-1, ENTRY // 2)[:, -4:]).view(">u4")[:, 0]
    return codes, chars, start, size


#: Nodes of a task: whole ones (``upper`` false) and its parts of those that other tasks may have, too.
NODES = ("task long, upper boolean, depth long, least long, n_convs long, n_children long, n_leaves long, "
         "saved long, chars long, ends string, parent_least long, parent string, path array<string>")
NODES_ARROW = pa.schema([("task", pa.int64()), ("upper", pa.bool_()), *[(c, pa.int64()) for c in (
    "depth", "least", "n_convs", "n_children", "n_leaves", "saved", "chars")], ("ends", pa.string()),
    ("parent_least", pa.int64()), ("parent", pa.string()), ("path", pa.list_(pa.string()))])


def _key(packed: str, depth: int) -> str:
    """The name of a node, from a sequence through it."""
    return hashlib.md5(packed[:ENTRY * depth].encode()).hexdigest()


def _nodes(rows: pa.Table) -> pa.Table:
    # in the order of their entries, so that sequences with a common prefix are neighbours
    rows = rows.sort_by([("packed", "ascending")])
    packed, ends_of = rows["packed"].to_pylist(), rows["ends"].to_pylist()
    shard, n, conv = (rows[c].to_numpy().astype(np.int64) for c in ("depth", "n", "least"))
    codes, chars_of, start, size = dense(packed)
    deepest = int(size.max())
    trie, state = DoubleArray(), np.zeros(len(packed), np.int64)
    for d in range(deepest):                        # pack, a level at a time
        on = np.flatnonzero(size > d)
        code = codes[start[on] + d]
        arc = np.unique(state[on] * len(chars_of) + code)
        trie.add(arc // len(chars_of), arc % len(chars_of))
        state[on] = trie.step(state[on], code)
    slots = len(trie.check)
    n_convs, least, chars = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64)
    upper, sample, depth = np.zeros(slots, bool), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    ends: dict[int, str] = {}
    state, levels = np.zeros(len(packed), np.int64), []
    for d in range(deepest + 1):                    # walk all sequences through the arrays
        on = np.flatnonzero(size >= d)
        if d:
            code = codes[start[on] + d - 1]
            state[on] = trie.step(state[on], code)
            chars[state[on]] = chars_of[code]
        at = state[on]
        np.add.at(n_convs, at, n[on])
        np.minimum.at(least, at, conv[on])
        upper[at], sample[at], depth[at] = d < shard[on], on, d
        ends.update((int(state[i]), ends_of[i]) for i in on[size[on] == d].tolist())
        levels.append(np.unique(at))
    n_children, n_leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    for d in range(deepest, -1, -1):                # sums over subtrees; those of upper nodes go on elsewhere
        whole = levels[d][~upper[levels[d]]]
        n_leaves[whole[n_children[whole] == 0]] = 1
        saved[whole] += (n_convs[whole] - 1) * chars[whole]
        if d:
            up = trie.check[whole]
            np.add.at(n_children, up, 1)
            np.add.at(n_leaves, up, n_leaves[whole])
            np.add.at(saved, up, saved[whole])
    every = np.concatenate(levels)
    above = trie.check[every]
    known = (depth[every] > 0) & ~upper[every] & ~upper[np.maximum(above, 0)]
    parent, path = [], []
    for s, up, k in zip(every.tolist(), above.tolist(), known.tolist()):
        seq, d = packed[sample[s]], int(depth[s])
        parent.append(None if k or upper[s] or not d else _key(seq, d - 1))
        path.append([_key(seq, j) for j in range(d + 1)] if upper[s] else None)
    columns = [pa.array(x[every]) for x in (depth, least, n_convs, n_children, n_leaves, saved, chars)]
    return pa.table([pa.array(np.full(len(every), rows["task"][0].as_py())), pa.array(upper[every]), *columns,
                     pa.array([ends.get(s) for s in every.tolist()], pa.string()),
                     pa.array(least[np.maximum(above, 0)], mask=~known), pa.array(parent, pa.string()),
                     pa.array(path, pa.list_(pa.string()))], schema=NODES_ARROW)


def prefix_trie(seqs: DataFrame, shard: int | None = None) -> DataFrame:
    """All nodes of the prefix trie of ``seqs`` (conv_id, packed), one row each.

    Returns conv_id (the least id of a conversation through the node), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes without
    children in the subtree, itself included), saved_tokens (over the subtree:
    conversations beyond the first times the length of the node's last text) and
    ends_sha256 (of the ids of the conversations that end there, ascending,
    comma-joined; of nothing if none). Conversations without turns are at the root
    only; an empty table gives no rows.
    """
    spark = configure(seqs.sparkSession)
    folder = work_dir(spark, "conversation-trie")
    distinct_sequences(seqs).write.parquet(f"{folder}/sequences")
    distinct = spark.read.parquet(f"{folder}/sequences")
    in_shards(distinct, shard or SHARD).groupBy("task").applyInArrow(_nodes, NODES).write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(NODES).parquet(f"{folder}/nodes")
    own = F.element_at("path", -1).alias("key")
    merged = (nodes.where("upper").groupBy(own).agg(
        F.max("path").alias("path"), F.max("depth").alias("depth"), F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("chars").alias("chars"), F.max("ends").alias("ends"))
        .withColumn("parent", F.when(F.col("depth") > 0, F.element_at("path", -2))))
    merged = checkpoint(merged)
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    merged = (merged.join(children, "key", "left")
              .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
              .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
              .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")))
    below = merged.select(F.explode("path").alias("key"), "n_leaves", "saved").groupBy("key").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    upper = merged.drop("n_leaves", "saved").join(below, "key")
    ids = merged.select(F.col("key").alias("parent"), F.col("least").alias("up"))
    upper = upper.join(ids, "parent", "left").withColumn("parent_least", F.col("up"))
    whole = nodes.where("NOT upper")
    asked = nodes.where("upper").select("task", F.element_at("path", -1).alias("parent")).join(ids, "parent")
    tops = whole.where("parent IS NOT NULL").join(asked, ["task", "parent"]).withColumn("parent_least", F.col("up"))
    shown = [F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs",
             "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
             F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")]
    return whole.where("parent IS NULL").select(*shown).unionAll(tops.select(*shown)).unionAll(upper.select(*shown))
