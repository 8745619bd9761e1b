import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Texts that every operator must take: missing, blank, long without a break, repeated, equal.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (6, "a" * 120_000), (7, "one two three four five " * 30),
       (7, "one two three four five " * 30), (8, "Ünïcödé ßtraße 日本語 🙂 end"), (9, "x " * 30_000)]


@pytest.fixture(scope="session")
def spark():
    from pumpwatch.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def odd(spark):
    """ODD with columns whose names operators use inside, and a row without an id."""
    rows = [(i, t, "en", "src", 1, "b", 0, "k") for i, t in ODD] + [(None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block long, body string, fp long, `key` string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, block long, body string, fp long, `key` string")
