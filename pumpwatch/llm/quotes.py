"""Chat formatting of quoted mail: quotation linking.

Messages are read line by line: the quote marks before a line give its level,
lines of one level in a row are a run. What is left at level 0 is the message's
own text. A quoted passage is the runs of one level with only deeper quotes
between them, as an interleaved message is quoted. Passages are normalised
(white space, case) and hashed, and joined to what the conversation's messages
said with the same hash: whole own texts first, then their runs, paragraphs and
lines. A passage that nobody said as such is looked up by its runs, then its
paragraphs, then its lines. The first message that said it is the original. A
message answers the latest original of its shallowest level that has one.
Following the answers gives each message its
root and depth, and (root, depth, turn) is an order in which every message comes
after the one that it answers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import checkpoint, mapped, text_bytes

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)*)(.*)", re.S)
BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")


def passages(body: str) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines with as many quote marks."""
    def split(line: str) -> tuple[int, str]:
        marks, text = MARKS.match(line).groups()
        return (marks.count(">"), text) if marks else (0, line)
    lines = map(split, body.split("\n"))
    return [(level, "\n".join(t for _, t in run)) for level, run in groupby(lines, key=lambda x: x[0])]


def passage_hash(text: str) -> str | None:
    """Hash of a passage but for white space and case; None if it is blank."""
    words = text.lower().split()
    return hashlib.md5(" ".join(words).encode()).hexdigest() if words else None


def quoted_passages(runs: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """(level, texts of its runs) of the quoted passages; a shallower line ends a passage, a deeper one doesn't."""
    out, open_ = [], []
    for level, text in runs:
        while open_ and open_[-1][0] > level:
            open_.pop()
        if level and not (open_ and open_[-1][0] == level):
            open_.append((level, []))
            out.append(open_[-1])
        if level:
            open_[-1][1].append(text)
    return out


#: Sizes of what is said or quoted: lines, paragraphs, runs, and whole own texts or passages.
WHOLE = 3


def parts(runs: list[str]) -> dict[str, int]:
    """Hashes of the text that ``runs`` make, of its runs, paragraphs and lines, with the largest size of each."""
    out: dict[str, int] = {}
    sizes = ["\n".join(runs)], runs, [p for r in runs for p in BLANK_LINES.split(r)], [x for r in runs for x in r.split("\n")]
    for size, texts in zip(range(WHOLE, -1, -1), sizes):
        for t in texts:
            if h := passage_hash(t):
                out.setdefault(h, size)
    return out


PARSED = ("conv_id long, turn long, role string, text string, said array<struct<size:int,hash:string>>, "
          "quoted array<struct<level:int,passage:string,size:int,hash:string>>")


def parse(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) to own text, and the hashes of what it says and quotes."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, said, quoted = [], [], []
            for body in b["body"]:
                runs = passages(body.decode("utf-8", "replace"))
                mine = [t for level, t in runs if not level]
                own.append("\n".join(mine).strip())
                said.append([(size, h) for h, size in parts(mine).items()])
                quoted.append([(level, passage_hash("\n".join(texts)), size, h)
                               for level, texts in quoted_passages(runs) for h, size in parts(texts).items()])
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "role": b["role"],
                                "text": own, "said": said, "quoted": quoted})
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           "role", text_bytes().alias("body")).transform(mapped, each, PARSED, ("conv_id", "turn"))


def answers(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_quoted, n_linked) of each message; parent is null without a link.

    Originals are pre-aggregated to the first turn of each conversation and
    hash, so a text that very many messages share is one row a conversation,
    and no pairs of equal texts are made.
    """
    first = parsed.select("conv_id", "turn", F.explode("said").alias("s")).groupBy("conv_id", F.col("s.hash").alias("hash")).agg(
        F.min(F.when(F.col("s.size") == WHOLE, F.col("turn"))).alias("_whole"), F.min("turn").alias("_any"))
    quotes = parsed.select("conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", "q.level", "q.passage", "q.size", "q.hash").distinct()
    before = [F.when(F.col(c) < F.col("turn"), F.col(c)) for c in ("_whole", "_any")]
    linked = quotes.join(first, ["conv_id", "hash"], "left").withColumn("original", F.coalesce(*before))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("size", "original")))
    linked = linked.groupBy("conv_id", "turn", "level", "passage").agg(best["original"].alias("original"))
    return linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"),
        F.max(F.when(F.col("original").isNotNull(), F.struct(-F.col("level"), F.col("original").alias("parent"))))
        .alias("best")).select("conv_id", "turn", F.col("best.parent").alias("parent"), "n_quoted", "n_linked")


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) to (conv_id, turn, root, depth), by doubling the steps.

    Messages that have come to a root are set aside, so the number of passes is
    the logarithm of the longest chain and the last ones are small.
    """
    columns = ["conv_id", "turn", "up", "depth"]
    steps = checkpoint(links.where("parent IS NOT NULL").select(
        "conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")).distinct())
    going, done = steps, None
    while True:
        next_ = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        both = checkpoint(going.join(next_, ["conv_id", "up"], "left"))
        ended = both.where("_up IS NULL").select(*columns)
        done = ended if done is None else done.unionAll(ended)
        going = both.where("_up IS NOT NULL").select(
            "conv_id", "turn", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        if going.isEmpty():
            return done.withColumnRenamed("up", "root")
        steps = done.unionAll(going)    # those at a root are still on the way of others


def link_conversations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, with what they answer.

    Returns conv_id, turn, role, text (own text), parent (turn or null), root,
    depth, n_quoted and n_linked (distinct quoted passages, and those with an
    original for them or a part of them). Null texts are empty; blank passages link nothing; repeated rows
    stay and get equal links; rows with a null conv_id or turn answer nothing.
    An empty table gives no rows. ``sort_chats`` brings the rows in order.
    """
    parsed = checkpoint(parse(messages))
    found = checkpoint(answers(parsed))
    depths = roots(found)
    key = ["conv_id", "turn"]
    return parsed.join(found, key, "left").join(depths, key, "left").select(
        "conv_id", "turn", "role", "text", "parent",
        F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def sort_chats(linked: DataFrame) -> DataFrame:
    """Linked messages in reply order, with ``chat``: the message in the form of a chat turn.

    Rows are dealt by ranges of the order itself, so a very long conversation is
    split over partitions like any other rows.
    """
    order = ["conv_id", "root", "depth", "turn"]
    return linked.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"),
                                              F.col("text"), F.lit("\n"))).orderBy(*order)


def quoting_mail(conversations: DataFrame, depth: int = 2) -> DataFrame:
    """``conversations`` as mail: each text with the ``depth`` turns before it, quoted.

    The text of k turns before stands in lines with k quote marks, as mail
    programs nest them. Messages are interleaved: each quote stands after the
    first line of the text that quotes it, in odd turns below all of it. Rows
    with equal (conv_id, turn) are quoted once, by their smallest text.
    """
    def cut(text):
        """Where the first line ends."""
        return F.coalesce(F.nullif(F.instr(text, "\n") - 1, F.lit(-1)), F.length(text))

    texts = conversations.groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("_text"))
    out = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    for k in range(1, depth + 1):
        before = texts.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("_text").alias(f"_{k}"))
        out = out.join(before, ["conv_id", "turn"], "left")
    inner = F.lit("")
    for k in range(depth, 0, -1):
        mark, text = "\n" + ">" * k + " ", F.col(f"_{k}")
        lines = lambda x: F.replace(x, F.lit("\n"), F.lit(mark))  # noqa: E731, B023
        at = cut(text)
        inner = F.when(text.isNull(), inner).otherwise(F.concat(
            F.lit(mark), F.substr(text, F.lit(1), at), inner, lines(F.substr(text, at + 1))))
    at = F.when(F.col("turn") % 2 == 1, F.length("text")).otherwise(cut(F.col("text")))
    return out.select("conv_id", "turn", "role", F.concat(
        F.substr("text", F.lit(1), at), inner, F.substr("text", at + 1)).alias("text"))
