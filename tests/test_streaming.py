"""Appending batches and streams to stored tables (an extension)."""

import os

import pytest
from pyspark.sql import types as T

from quern import Engine, EngineError
from quern.streaming import append, follow


def test_append_and_follow(spark, tmp_path):
    session = Engine(spark).session()
    session.execute("create table t (k int primary key, v text default 'none', n int check (n < 100))")
    session.execute("insert into t values (-1, 'x', 1)")
    assert append(session, "t", spark.createDataFrame([(1, 5), (2, None)], "k int, n int")) == 2
    assert session.execute("select * from t").rows() == [(-1, "x", 1), (1, "none", 5), (2, "none", None)]
    for rows, code in (([(1, 5)], 412), ([(7, 5), (7, 6)], 412), ([(8, 100)], 413), ([(None, 1)], 411)):
        with pytest.raises(EngineError) as caught:
            append(session, "t", spark.createDataFrame(rows, "k int, n int"))
        assert caught.value.code == code
    source = tmp_path / "in"
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType())])
    spark.createDataFrame([(10, 1), (11, 2)], schema).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = follow(session, "t", stream, str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(60)
    assert session.execute("select count(*), max(k) from t").rows() == [(5, 11)]


def test_a_batch_is_added_once_and_a_refused_one_leaves_nothing(spark):
    engine = Engine(spark)
    session = engine.session()
    session.execute("create table t (a int not null)")
    batch = spark.range(3).selectExpr("cast(id as int) as a")
    assert append(session, "t", batch, ("s", 0)) == 3 and append(session, "t", batch, ("s", 0)) == 0
    assert append(session, "t", batch.limit(0), ("s", 1)) == 0 and append(session, "t", batch, ("s", 1)) == 0
    assert append(session, "t", batch, ("other", 0)) == 3 and session.execute("select count(*) from t").rows() == [(6,)]
    folder = f"{engine.store.folder}/{session.space().table('t').uid}".removeprefix("file://")
    before = sorted(os.listdir(folder))
    with pytest.raises(EngineError):
        append(session, "t", batch.selectExpr("cast(null as int) as a"))
    assert sorted(os.listdir(folder)) == before
