"""Separator scan: exact counts from flat files, whatever the block size."""

import numpy as np
import public_tokenizers as public
import pytest

from pumpwatch.llm import token_files as tf

RANKS, EOD = public.path("byte_bpe_50k.tiktoken"), 50256


@pytest.mark.parametrize("block", [1 << 18, 7, 1])
def test_round_trip(spark, odd, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK", block)
    docs = odd.where("doc_id IS NULL OR doc_id NOT IN (6, 9)") if block < 10 else odd
    tf.write_token_files(docs, str(tmp_path / "t"), RANKS, public.PATTERN, EOD)
    got = tf.count_tokens(spark, str(tmp_path / "t"), EOD, lead=tf.HEADER)
    rows = sorted(((r.i, r.n_tokens) for r in got.select(tf.header_id("header").alias("i"), "n_tokens").collect()), key=repr)
    enc = tf.encoding(RANKS, public.PATTERN)
    want = sorted(((r.doc_id, sum(len(enc.encode_ordinary(p)) for p in tf.pieces(r.text or ""))) for r in docs.collect()), key=repr)
    assert rows == want


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1000])
def test_flat_files_of_others(spark, tmp_path, monkeypatch, block):
    """Four-byte ids, empty documents, separators at either end of a block, an open last document."""
    monkeypatch.setattr(tf, "BLOCK", block)
    r = np.random.default_rng(3)
    want = []
    for f in range(4):
        ids = r.choice([1, 2, 99], r.integers(0, 30), p=[.4, .3, .3])
        ids.astype("<u4").tofile(tmp_path / f"{f}.bin")
        start = 0
        for e in [*np.flatnonzero(ids == 99), len(ids)]:
            if start < len(ids):
                want.append((f"{f}.bin", int(start), int(e - start)))
            start = e + 1
    rows = tf.count_tokens(spark, str(tmp_path), 99, kind="<u4").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.start, r.n_tokens) for r in rows) == sorted(want)


def test_headers_and_no_documents(spark, empty, tmp_path):
    for i in (0, 1, -1, 50_256, 10 ** 15, -10 ** 15, None):
        assert max(tf.header(i)) < tf.RADIX and len(tf.header(i)) == tf.HEADER
        row = spark.createDataFrame([(tf.header(i),)], "h array<long>").select(tf.header_id("h")).first()
        assert row[0] == i
    tf.write_token_files(empty, str(tmp_path / "none"), RANKS, public.PATTERN, EOD)
    assert tf.count_tokens(spark, str(tmp_path / "none"), EOD).count() == 0


def test_pieces():
    text = "ab " * 100 + "x" * 300
    assert "".join(tf.pieces(text, 50)) == text and max(map(len, tf.pieces(text, 50))) <= 50


def test_long_texts_count_as_whole_texts(spark, tmp_path):
    """No cut inside a word, a run of spaces or of newlines, however long the text."""
    texts = ["hello\nworldly\n" * 20_000, "one\ttwo " * 20_000, "ab" + " " * 65_533 + "  cd" * 9, "\n\nx" * 40_000,
             "日本語の文" * 20_000, "x" * 65_535 + "  y " * 9, "it's" * 20_000]
    blank = ["a" + " " * 70_000 + "b\n\nc", "\n" * 1_200_000 + "z"]
    enc = tf.encoding(RANKS, public.PATTERN)
    docs = spark.createDataFrame(list(enumerate(texts + blank)), "doc_id long, text string")
    tf.write_token_files(docs, str(tmp_path / "t"), RANKS, public.PATTERN, EOD)
    got = tf.count_tokens(spark, str(tmp_path / "t"), EOD, lead=tf.HEADER)
    rows = dict(got.select(tf.header_id("header"), "n_tokens").collect())
    newlines = len(enc.encode_ordinary("\n" * 1000)) / 1000           # each newline of a run alike
    want = [len(enc.encode_ordinary(t)) for t in texts + blank[:1]] + [round(1_199_999 * newlines) + 2]
    assert [rows[i] for i in range(len(want))] == want
    for t in texts + blank[:1]:
        walked = [i for m in tf.regex.finditer(public.PATTERN, t) for i in enc._encode_single_piece(m.group())]
        assert walked == enc.encode_ordinary(t)
