"""Every query of the dialect against DuckDB, and the plans of the ones that matter at scale."""

import os

import duckdb
import pytest

from quern import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't there")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in rows))


@needs_data
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_against_oracle(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, SF)
    found = oracle.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert plain(frame.select(columns).collect()) == plain(found.fetchall())


def formatted(frame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    plan = formatted(catalogue.QUERIES["where_range_and"](spark, SF))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in plan
    plan = formatted(catalogue.QUERIES["like_prefix"](spark, SF))
    assert "StringStartsWith(p_brand,Brand#1)" in plan


@needs_data
def test_joins_are_hash_or_merge_joins(spark):
    plan = formatted(catalogue.QUERIES["join_comma_where"](spark, SF))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = formatted(catalogue.QUERIES["order_by_limit_topn"](spark, SF))
    assert "TakeOrderedAndProject" in plan


def test_the_entry_works_without_the_corpus_part(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("quern.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    names = set(entry.queries())
    assert names == set(catalogue.QUERIES) and set(entry.oracle_sql()) <= names
