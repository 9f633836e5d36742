"""Registry of the runnable queries: name -> callable(spark, sf_dir) -> DataFrame.

Names follow SURVEY §7.5: inventory id in lower case plus a short name.  Every
query reads the driver's tables (through ``sources.testdata``) so its work grows
with them.  A query may carry the DuckDB text that computes the same result over
the same parquet views (the correctness oracle); queries that SQL cannot express
(tree ensembles, SVM, streaming state) carry none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import tables
from .oracle_prelude import with_prelude

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return _fn(tables(spark, sf_dir))
        run.__doc__ = fn.__doc__
        run.__name__ = name
        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = with_prelude(sql)
        return fn
    return deco


def load_all() -> tuple[dict, dict]:
    from . import registered, registered_detect, registered_more, registered_parse, registered_stream  # noqa: F401
    return dict(REGISTRY), dict(ORACLE)
