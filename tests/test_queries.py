"""Every registered query outside the llm subpackage against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from rulewright.plans import queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select([f"`{c}`" for c in columns]).collect())
    found = duck.execute(queries.ORACLE[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(norm(r[at.index(c)]) for c in columns) for r in found.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["b15_profile_table", "g7_iteration_log", "h9_baseline_tree"])
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry_without_the_llm_subpackage(spark, monkeypatch):
    import importlib
    import sys

    for gone in ("corpus_pipeline", "__spark_entry__"):
        monkeypatch.delitem(sys.modules, gone, raising=False)
    real = importlib.import_module("builtins").__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr("builtins.__import__", missing)
    entry = importlib.import_module("__spark_entry__")
    assert not any(k.startswith("op1_") for k in entry.queries()) and entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
