"""Ids come back as they were: a null beside numbers that no floating point number holds."""

import pytest
from pyspark.sql import functions as F

from pumpwatch.llm import (bpe_automaton, decontaminate, fingerprint, language_id, lm_score, pii, quotes, simhash_dedup,
                           suffix_dedup, token_files)
from pumpwatch.llm.queries import EOD, piece_vocabulary, word_bpe

IDS = [2**53 + 1, 2**53 + 3, -2**63, 2**63 - 1, -2**62, 5, None]
PASSAGE = " ".join(f"unusual passage word{i}" for i in range(12))


def token_counts(docs, tmp_path):
    import public_tokenizers
    token_files.write_token_files(docs, f"{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, EOD)
    found = token_files.count_tokens(docs.sparkSession, f"{tmp_path}/t", EOD, lead=token_files.HEADER)
    return found.select(token_files.header_id("header").alias("doc_id"))


OPERATORS = {
    "op1": lambda d, t: suffix_dedup.remove_repeats(d),
    "op2": lambda d, t: decontaminate.find_leaks(d, d.sparkSession.createDataFrame([(2**53 + 1, PASSAGE), (None, "x y z u v w")], "item_id long, text string")),
    "op3": lambda d, t: language_id.identify(d, piece_vocabulary()),
    "op4": lambda d, t: bpe_automaton.encode_documents(d, word_bpe()),
    "op5": lambda d, t: simhash_dedup.simhash_components(d),
    "op7": lambda d, t: pii.pseudonymise(d),
    "op8": lambda d, t: lm_score.score_documents(d),
    "op9": lambda d, t: fingerprint.fingerprint_documents(d),
    "op10": token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_document_ids(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, f"{PASSAGE} and {k}", "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string")
    rows = OPERATORS[name](docs.coalesce(1), tmp_path).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted(IDS, key=str)
    if name == "op2":
        assert {r.item_id for r in rows} == {2**53 + 1}


def test_conversation_ids(spark):
    mail = spark.createDataFrame([(i, t, "u", "hello") for i in IDS for t in (2**53 + 1, 2**53 + 3, None)], "conv_id long, turn long, role string, text string")
    got = quotes.link_conversations(mail.coalesce(1)).select("conv_id", "turn").distinct().collect()
    assert {(r.conv_id, r.turn) for r in got} == {(i, t) for i in IDS for t in (2**53 + 1, 2**53 + 3, None)}


def test_many_rows_without_an_id_are_spread_over_blocks(spark):
    from pumpwatch.llm.common import in_blocks
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.col("id").cast("string"), F.lit(50)).alias("text"))
    dealt, blocks = in_blocks(docs, 4000)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert blocks > 5 and max(sizes) < 100
