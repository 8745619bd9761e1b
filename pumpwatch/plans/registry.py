"""Registry of named queries: Spark plan + equivalent ANSI SQL oracle.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame over the whole
given tables. The SQL text (DuckDB dialect, tables registered as views) is
the independent oracle the result is compared with; entries without SQL are
checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pumpwatch.plans.present import present
from pumpwatch.session import configure


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return present(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, build, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the catalogue modules fills REGISTRY
    from pumpwatch.plans import history_queries  # noqa: F401
    from pumpwatch.plans import snapshot_queries  # noqa: F401
    from pumpwatch.plans import pivot_queries  # noqa: F401
    from pumpwatch.plans import feed_queries  # noqa: F401
    from pumpwatch.plans import archive_queries  # noqa: F401
    from pumpwatch.plans import report_queries  # noqa: F401
    from pumpwatch.plans import streaming_queries  # noqa: F401
    return REGISTRY
