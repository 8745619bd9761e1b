"""Quotation linking: levels, originals, reply order."""

import random

from pumpwatch.llm import quotes as qt

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return {(r.conv_id, r.turn): r for r in qt.link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_levels():
    assert qt.passages("a\n> b\n>c\n>> d\n > > e\nf") == [(0, "a"), (1, "b\nc"), (2, "d\ne"), (0, "f")]
    assert qt.passage_hash(" A  b\n") == qt.passage_hash("a B") and qt.passage_hash(" \n") is None


def test_branches_and_fallback(spark):
    got = linked(spark, [
        (1, 0, "user", "Hello there"), (1, 1, "a", "First\n> hello   THERE"), (1, 2, "a", "Second\n> Hello there"),
        (1, 3, "user", "on the first\n> First\n>> Hello there"),
        (1, 4, "user", "its parent is lost\n> gone\n>> First"), (1, 5, "user", "no quote"), (1, 6, "user", "> later"),
        (1, 7, "user", "later"), (2, 1, "user", "other talk\n> Hello there")])
    assert {k[1]: (r.parent, r.root, r.depth) for k, r in got.items() if k[0] == 1} == {
        0: (None, 0, 0), 1: (0, 0, 1), 2: (0, 0, 1), 3: (1, 0, 2), 4: (1, 0, 2), 5: (None, 5, 0), 6: (None, 6, 0), 7: (None, 7, 0)}
    assert (got[1, 4].n_quoted, got[1, 4].n_linked) == (2, 1) and got[2, 1].parent is None
    assert got[1, 3].text == "on the first"


def test_long_conversation_and_order(spark):
    n = 150
    rows = [(1, t, "user", f"message {t}" + (f"\n> message {t - 1}" if t else "")) for t in range(n)]
    got = linked(spark, rows)
    assert all(got[1, t].depth == t and got[1, t].root == 0 for t in range(n))
    chats = qt.sort_chats(qt.link_conversations(spark.createDataFrame(rows[::-1], SCHEMA))).collect()
    assert [r.chat for r in chats] == [f"<|user|>\nmessage {t}\n" for t in range(n)]


def test_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, None, "same"), (1, 2, "user", "same\n> same"), (1, 2, "user", "same\n> same"),
            (None, 1, "user", "> x"), (3, None, "user", "> x"), (1, 3, "user", "y " * 60_000 + "\n> same")]
    out = qt.link_conversations(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == len(rows)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert got[1, 2].parent == 1 and got[1, 3].parent == 1 and got[None, 1].parent is None
    assert qt.sort_chats(qt.link_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    assert qt.quoting_mail(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1").count() >= 6


def test_partial_and_interleaved_quotes(spark):
    """Every kind of part of messages with unlike lines: the parent is the message that was quoted."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4))
    rows, want = [], {}
    for conv in range(40):
        own, mail = [], []
        for turn in range(8):
            paragraphs = [[line() for _ in range(r.randint(1, 3))] for _ in range(r.randint(2, 3))]
            text = "\n\n".join("\n".join(x) for x in paragraphs)
            if not turn:
                body = text
            else:
                to = r.randrange(turn)
                kind = r.choice(["whole", "paragraph", "line", "lines", "mail", "two"])
                lines = own[to].split("\n")
                some = [x for x in lines if x]
                quote = {"whole": lines, "paragraph": own[to].split("\n\n")[r.randint(0, 1)].split("\n"),
                         "line": [r.choice(some)], "lines": lines[1:], "mail": mail[to].split("\n"),
                         "two": [some[0].upper(), "", some[-1]]}[kind]
                quote = "\n".join(">" + ("" if x.startswith(">") else " ") + x for x in quote)
                first, rest = text.split("\n\n", 1)
                body = r.choice([f"{text}\n{quote}", f"{quote}\n{text}", f"{first}\n{quote}\n\n{rest}"])
                want[conv, turn] = to
            own.append(text)
            mail.append(body)
            rows.append((conv, turn, "user", body))
    got = linked(spark, rows)
    assert {k: got[k].parent for k in want} == want
    assert all(got[k].n_linked == got[k].n_quoted for k in want)


def test_whole_messages_come_before_parts(spark):
    got = linked(spark, [(1, 0, "u", "hi\nok"), (1, 1, "u", "b1\n> hi\n> ok\nb2"), (1, 2, "u", "ok"), (1, 3, "u", "x\n> ok"),
                         (1, 4, "u", "> b1\n>> hi\n>> ok\n> b2"), (1, 5, "u", "> b2\nyes\n> hi\n"), (1, 6, "u", "> none\n>> b1\n> at all")])
    assert {t: got[1, t].parent for t in range(7)} == {0: None, 1: 0, 2: None, 3: 2, 4: 1, 5: 1, 6: 1}
    assert (got[1, 4].n_quoted, got[1, 6].n_quoted, got[1, 6].n_linked) == (2, 2, 1)


def test_mail_is_interleaved(spark):
    rows = [(1, 0, "u", "a1\na2"), (1, 1, "u", "b1\n\nb2"), (1, 2, "u", "c1\nc2"), (1, 4, "u", None), (1, 5, "u", "e")]
    mail = {r.turn: r.text for r in qt.quoting_mail(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert mail[1] == "b1\n\nb2\n> a1\n> a2"
    assert mail[2] == "c1\n> b1\n>> a1\n>> a2\n> \n> b2\nc2" and mail[4] == "\n>> c1\n>> c2"
    got = linked(spark, [(1, t, "u", x) for t, x in mail.items()])
    assert {t: (x.parent, x.text) for (_, t), x in got.items()} == {
        0: (None, "a1\na2"), 1: (0, "b1\n\nb2"), 2: (1, "c1\nc2"), 4: (2, ""), 5: (None, "e")}
