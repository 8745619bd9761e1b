"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwatch.llm import (bpe_automaton, conversation_trie, decontaminate, fingerprint, language_id, lm_score, page_text, pii,
                           quotes, simhash_dedup, suffix_dedup, token_alignment, token_files)
from pumpwatch.llm.common import read, work_dir


#: Identifier after the 50,256 of the rank file.
EOD = 50256


def word_bpe() -> str:
    """The public tokenizer file with word ends, installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def piece_vocabulary() -> str:
    """The public piece vocabulary, installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"), piece_vocabulary())
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(read(spark, sf_dir, "documents"), word_bpe(), contents=False)


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail that quotes the two turns before, read back and linked."""
    mail = quotes.quoting_mail(read(spark, sf_dir, "conversations"))
    return quotes.sort_chats(quotes.link_conversations(mail))


OP6_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, trim(coalesce(text, ''), E' \t\r\n') AS text,
         lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm
  FROM conversations),
one AS (SELECT conv_id, turn, min(norm) AS norm FROM said GROUP BY conv_id, turn),
origin AS (SELECT conv_id, norm, min(turn) AS original FROM said WHERE norm <> '' GROUP BY conv_id, norm),
quoted AS (
  SELECT DISTINCT s.conv_id, s.turn, k.k, o.norm
  FROM said s, (VALUES (1), (2)) k(k), one o
  WHERE o.conv_id = s.conv_id AND o.turn = s.turn - k.k AND o.norm <> ''),
answer AS (
  SELECT q.conv_id, q.turn, count(*) AS n_quoted, count(o.original) AS n_linked,
         coalesce(max(o.original) FILTER (q.k = 1), max(o.original) FILTER (q.k = 2)) AS parent
  FROM quoted q LEFT JOIN origin o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.original < q.turn
  GROUP BY q.conv_id, q.turn),
node AS (SELECT DISTINCT s.conv_id, s.turn, a.parent FROM said s LEFT JOIN answer a USING (conv_id, turn)),
tree AS (
  SELECT conv_id, turn, turn AS root, 0::BIGINT AS depth FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, t.root, t.depth + 1 FROM node n JOIN tree t ON t.conv_id = n.conv_id AND t.turn = n.parent)
SELECT s.conv_id, s.turn, s.role, s.text, a.parent, t.root, t.depth,
       coalesce(a.n_quoted, 0) AS n_quoted, coalesce(a.n_linked, 0) AS n_linked,
       '<|' || coalesce(s.role, 'user') || E'|>\n' || s.text || E'\n' AS chat
FROM said s LEFT JOIN answer a USING (conv_id, turn) JOIN tree t USING (conv_id, turn)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and how many values of each kind were replaced."""
    done = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind))
    return done.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in pii.KINDS])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of the documents, scanned for the end of each."""
    import public_tokenizers
    folder = work_dir(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, EOD)
    found = token_files.count_tokens(spark, folder, EOD, lead=token_files.HEADER)
    return found.select(token_files.header_id("header").alias("doc_id"), "n_tokens")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    found = token_alignment.align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                            piece_vocabulary(), contents=False)
    return found.drop("groups")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.sequences(read(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.with_shared_heads(own))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup,
    op2_decontamination,
    op3_language_id,
    op4_bpe_automaton,
    op5_simhash_near_dedup,
    op6_chat_quotes,
    op7_pii,
    op8_lm_scoring,
    op9_document_fingerprints,
    op10_token_counts,
    op11_token_alignment,
    op12_conversation_trie,
    op13_html_extraction,
)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op6_chat_quotes": OP6_SQL}
