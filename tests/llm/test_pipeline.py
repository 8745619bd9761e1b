"""The pipeline's stages against brute-force versions, each on its own input, and the registration."""

import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from pumpwatch.llm import decontaminate, queries, simhash_dedup
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash_dedup import classes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(-1, "12 34", "en", "x", 5), (-2, None, "en", "x", 0)], docs.schema)
    steps = [docs.unionAll(noise)]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    for s in steps[1:-1]:
        assert s.columns == docs.columns
    assert set(rows[1]) == set(rows[0]) - {-1, -2}
    ids = sorted(rows[1])
    groups = classes(ids, [simhash_dedup.fingerprint(rows[1][i].text.encode()) for i in ids])
    assert set(rows[2]) == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute([(i, r.text) for i, r in rows[2].items()], items, decontaminate.SIMILARITY)}
    assert leaks and set(rows[3]) == set(rows[2]) - leaks
    assert set(rows[4]) == set(rows[3]) and any(rows[4][i].text != rows[3][i].text for i in rows[4])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.ids == tok.encode(rows[4][i].text, add_special_tokens=False).ids for i, r in rows[5].items())
    assert len(rows[5]) == len(rows[4])


def test_run_and_registration(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(queries.ORACLES) <= names
    assert 0 < cp.run(spark, SF).count() <= 200
