"""DML, DDL, constraints, transactions, saving; on tables of our own."""

import io
import json
import os

import pytest

from quern import Engine, EngineError
from quern.shell import Shell


def code(session, sql):
    with pytest.raises(EngineError) as caught:
        session.execute(sql).rows()
    return caught.value.code


@pytest.fixture
def session(spark):
    return Engine(spark).session()


def rows(session, sql):
    return session.execute(sql).rows()


def test_insert_defaults_and_constraints(session):
    session.execute("create table acct (no int primary key, mail text unique, nick varchar(4) not null, kind text default 'std', age int default 1 check (age > 0), check (age < no * 100))")
    assert session.execute("insert into acct values (1, 'a', 'abc', 'x', 5)").message == "1 row inserted into acct"
    session.execute("insert into acct (nick, no) values ('éé', 2)")
    assert rows(session, "select * from acct") == [(1, "a", "abc", "x", 5), (2, None, "éé", "std", 1)]
    for number, sql in (
        (412, "insert into acct values (1, 'z', 'z', 'x', 5)"),
        (411, "insert into acct (no, nick) values (NULL, 'q')"),
        (412, "insert into acct (no, mail, nick) values (3, 'a', 'q')"),
        (414, "insert into acct (no, nick) values (3, 'ééé')"),
        (413, "insert into acct (no, nick, age) values (3, 'q', -1)"),
        (413, "insert into acct (no, nick, age) values (3, 'q', 301)"),
        (316, "insert into acct (no) values (3)"),
        (305, "insert into acct (no, no, nick) values (3, 3, 'q')"),
        (302, "insert into acct (no, nope) values (3, 3)"),
        (304, "insert into acct values (3)"),
    ):
        assert code(session, sql) == number, sql
    session.execute("insert into acct (no, nick, age) values (4, 'q', NULL)")  # an unknown CHECK passes
    assert code(session, "update acct set no = 2 where no = 1") == 412
    assert code(session, "update acct set mail = 'same'") == 412
    assert code(session, "update acct set age = -5 where no = 1") == 413
    assert code(session, "update acct set nick = NULL where no = 1") == 411
    assert code(session, "update acct set nick = 'abcde' where no = 1") == 414
    assert code(session, "update acct set no = no + 1") == 412
    assert session.execute("update acct set no = no + 10").rows_affected == 3
    assert rows(session, "select no from acct order by no") == [(11,), (12,), (14,)]
    session.execute("delete from acct where no = 11")
    session.execute("insert into acct values (11, 'a', 'abc', 'x', 5)")


def test_update_and_delete(session):
    session.execute("create table p (a int, b int)")
    for k in range(5):
        session.execute(f"insert into p values ({k}, {k * k})")
    assert session.execute("update p set a = b, b = a where a >= 2 and a < 4").message == "2 row(s) updated in p"
    assert rows(session, "select a, b from p") == [(0, 0), (1, 1), (4, 16), (4, 2), (9, 3)]
    assert session.execute("update p set a = 1 where a > 100").message == "0 row(s) updated in p"
    assert code(session, "update p set a = a / (a - 4)") == 415
    assert session.execute("delete from p where a in (select max(a) from p)").rows_affected == 1
    assert session.execute("delete from p where b > 10 or a / b > 1").rows_affected == 2
    assert rows(session, "select a, b from p") == [(0, 0), (1, 1)]
    assert session.execute("vacuum p").message == "p: 7 slot(s) compacted to 2 row(s), 5 reclaimed"
    assert session.execute("vacuum p").message == "p: 2 slot(s) compacted to 2 row(s), 0 reclaimed"
    assert rows(session, "select a, b from p") == [(0, 0), (1, 1)]
    assert session.execute("delete from p").rows_affected == 2
    assert rows(session, "select count(*) from p") == [(0,)]


def test_many_inserts_are_few_jobs(spark, session):
    session.execute("create table m (k int primary key, v text)")
    session.execute("begin")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for k in range(500):
        session.execute(f"insert into m values ({k}, 'v{k}')")
    assert len(tracker.getJobIdsForGroup(None)) == before
    session.execute("commit")
    assert code(session, "insert into m values (7, 'again')") == 412
    assert rows(session, "select count(*), max(k) from m") == [(500, 499)]


def test_alter(session):
    session.execute("create table t (a int, b int check (b > 0))")
    session.execute("insert into t values (1, 2)")
    assert code(session, "alter table t drop column a") == 320
    session.execute("alter table t rename column b to c")
    assert code(session, "insert into t values (1, -2)") == 413
    session.execute("create table u (a int, b text)")
    session.execute("insert into u values (1, 'x')")
    session.execute("update u set a = 2")  # so that a segment is written
    session.execute("alter table u add column d float default 1.5")
    session.execute("alter table u add e text")
    session.execute("insert into u values (3, 'y', 2.5, 'z')")
    assert rows(session, "select * from u") == [(2, "x", 1.5, None), (3, "y", 2.5, "z")]
    assert code(session, "alter table u add a int") == 305
    assert code(session, "alter table u add g int unique") == 319
    assert code(session, "alter table u add g int not null") == 316
    assert code(session, "alter table u add g date default 'soon'") == 317
    session.execute("create index by_b on u (b)")
    assert code(session, "create index by_b on u (a)") == 307
    session.execute("alter table u drop b")
    assert session.indexes() == "--- no indexes ---"
    session.execute("alter table u add b int default 9")
    assert rows(session, "select b, a from u order by a") == [(9, 2), (9, 3)]
    session.execute("alter table u rename to w")
    assert code(session, "select a from u") == 300
    assert code(session, "alter table w rename to t") == 301
    session.execute("create table one (a int)")
    assert code(session, "alter table one drop a") == 318


def test_databases_and_listings(session):
    session.execute("create table t (id int primary key, s varchar(3) not null, d date default '2020-01-01', check (id > 0))")
    assert session.tables() == "--- catalog (main) ---\nt(id int primary key, s varchar(3) not null, d date default) check"
    assert session.indexes() == "--- indexes (main) ---\nt_id_key on t(id)"
    session.execute("create database side")
    session.execute("use side")
    session.execute("create table t (x text)")
    assert session.databases() == "--- databases ---\nmain\nside  (current)"
    assert code(session, "create database side") == 310
    assert code(session, "drop database main") == 312
    session.execute("drop database side")
    assert session.current == "main"
    session.execute("drop table t")
    assert code(session, "drop table t") == 300


def test_transactions(session):
    session.execute("create table t (a int)")
    session.execute("begin")
    assert code(session, "begin") == 408
    session.execute("insert into t values (1)")
    session.execute("create table extra (a int)")
    assert code(session, "insert into t values (1, 2)") == 304
    session.execute("rollback")
    assert rows(session, "select count(*) from t") == [(0,)]
    assert code(session, "select a from extra") == 300
    assert code(session, "commit") == 409
    assert code(session, "rollback") == 409
    session.execute("begin")
    session.execute("insert into t values (2)")
    session.close()
    assert rows(session, "select count(*) from t") == [(0,)]


def test_compat(spark):
    session = Engine(spark, compat=True).session()
    session.execute("create table t (a int)")
    session.execute("begin")
    session.execute("insert into t values (2147483647)")
    session.execute("insert into t values (1)")
    assert code(session, "rollback") == 410
    assert code(session, "select sum(a) from t") == 103
    session.execute("commit")


def test_save_and_load(spark, session, tmp_path):
    session.execute("create table t (id int primary key, s text, f float, d date, check (id > 0 and (s like 'a%' or f / 2.0 >= 0.25)))")
    session.execute("insert into t values (1, 'a''b', 0.1, '2020-02-29')")
    session.execute("insert into t values (2, NULL, 1.5, NULL)")
    session.execute("create database empty_one")
    folder = str(tmp_path / "kept")
    session.save(folder)
    other = Engine(spark).session()
    other.load(folder)
    assert other.execute("select * from t").rows() == session.execute("select * from t").rows()
    assert code(other, "insert into t values (2, 'a', 1.0, NULL)") == 412
    assert code(other, "insert into t values (3, 'b', 0.1, NULL)") == 413
    assert other.databases().endswith("empty_one")
    with pytest.raises(EngineError) as caught:
        other.load(str(tmp_path / "missing"))
    assert caught.value.code == 600
    assert len(other.execute("select * from t").rows()) == 2
    for text, number in (("{", 601), (json.dumps({"namespaces": [], "format": 99}), 602)):
        os.makedirs(tmp_path / "bad", exist_ok=True)
        (tmp_path / "bad/_manifest.json").write_text(text)
        with pytest.raises(EngineError) as caught:
            other.load(str(tmp_path / "bad"))
        assert caught.value.code == number


def test_a_database_in_a_folder_survives(spark, tmp_path):
    folder = str(tmp_path / "db")
    one = Engine(spark, folder).session()
    one.execute("create table t (a int, s text)")
    one.execute("insert into t values (1, 'x')")
    one.execute("insert into t values (2, 'y')")
    two = Engine(spark, folder).session()  # as after a crash: nothing was closed
    assert two.execute("select a, s from t").rows() == [(1, "x"), (2, "y")]
    with open(f"{folder}/_journal.jsonl", "ab") as file:
        file.write(b'{"commit": 1, "rows": [["main", "t", {"f0"')  # a torn line
    assert Engine(spark, folder).session().execute("select count(*) from t").rows() == [(2,)]
    two.execute("update t set s = 'z' where a = 1")
    two.execute("begin")
    two.execute("delete from t")
    three = Engine(spark, folder).session()  # the transaction was never committed
    assert three.execute("select a, s from t order by a").rows() == [(1, "z"), (2, "y")]
    two.execute("rollback")
    assert two.execute("select count(*) from t").rows() == [(2,)]
    two.execute("vacuum t")
    assert Engine(spark, folder).session().execute("select a, s from t order by a").rows() == [(1, "z"), (2, "y")]


def test_a_segment_without_its_manifest_does_not_count(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "db")
    session = Engine(spark, folder).session()
    session.execute("create table t (a int)")
    session.execute("insert into t values (1)")
    monkeypatch.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    assert code(session, "update t set a = 5") == 603
    monkeypatch.undo()
    assert Engine(spark, folder).session().execute("select a from t").rows() == [(1,)]


def test_shell(spark, tmp_path):
    out = io.StringIO()
    shell = Shell(Engine(spark).session(), out)
    shell.run([
        "create table t (a int, f float)", "insert into t values (1, 0.333333333)", "-- a comment", "", "select * from t", "select a from nothing",
        ".tables", ".nothing", f".save {tmp_path}/s", ".exit", "select a from t",
    ])
    assert out.getvalue() == (
        "table t created with 2 column(s)\n1 row inserted into t\na | f\n1 | 0.333333\n(1 row)\nerror 300: no such table\n"
        f"--- catalog (main) ---\nt(a int, f float)\nunrecognised command: .nothing\nsaved to {tmp_path}/s\n"
    )


def test_an_index_sorts_the_rows(spark):
    import pyarrow.parquet as pq

    from quern.streaming import append

    session = Engine(spark).session()
    session.execute("create table t (a int, b text)")
    append(session, "t", spark.range(5000).selectExpr("cast(id * 7919 % 5000 as int) as a", "cast(id as string) as b").repartition(3))
    before = session.execute("select a, b from t limit 5").rows()
    session.execute("create index by_a on t (a)")
    (segment,) = session.space().table("t").segments
    path = segment.path.removeprefix("file://")
    (file,) = [f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet")]
    table = pq.read_table(file)
    assert table.column("f0").to_pylist() == list(range(5000))
    assert pq.ParquetFile(file).metadata.row_group(0).column(1).statistics.max == 4999
    assert session.execute("select a, b from t limit 5").rows() == before  # arrival order is as it was
    session.execute("insert into t values (-1, 'new')")
    session.execute("vacuum t")
    assert session.execute("select b from t where a = -1").rows() == [("new",)]


def test_a_transaction_is_seen_at_commit_only(spark):
    engine = Engine(spark)
    one, two = engine.session(), engine.session()
    one.execute("create table t (a int)")
    one.execute("begin")
    one.execute("insert into t values (1)")
    one.execute("create table u (a int)")
    assert one.execute("select a from t").rows() == [(1,)] and two.execute("select a from t").rows() == []
    with pytest.raises(EngineError):
        two.execute("select a from u")
    one.execute("commit")
    assert two.execute("select a from t").rows() == [(1,)] and two.execute("select a from u").rows() == []
    one.execute("begin")
    one.execute("update t set a = 2")
    one.close()
    assert two.execute("select a from t").rows() == [(1,)]


def test_updates_break_rules_in_order(spark):
    session = Engine(spark).session()
    session.execute("create table t (a int unique, b int not null)")
    session.execute("insert into t values (1, 1)")
    session.execute("insert into t values (2, 2)")
    with pytest.raises(EngineError) as error:
        session.execute("update t set a = 1, b = NULL where a = 2")
    assert error.value.code == 412


def test_a_limit_reads_the_first_segments(spark):
    from quern.streaming import append

    session = Engine(spark).session()
    session.execute("create table t (a int)")
    for k in range(3):
        append(session, "t", spark.range(10 * k, 10 * k + 10).selectExpr("cast(id as int) as a"))
    table = session.space().table("t")
    assert len(table.first(10).segments) == 1 and len(table.first(11).segments) == 2 and table.first(0).segments == ()
    plan = session.query("select a from t limit 4")._jdf.queryExecution().optimizedPlan().toString()
    assert session.execute("select a from t limit 4").rows() == [(0,), (1,), (2,), (3,)]
    assert session.execute("select a from t limit 25").rows()[-1] == (24,) and "Union" not in plan


def test_the_plans_of_stored_tables(spark):
    session = Engine(spark).session()
    session.execute("create table t (a int, b text)")
    session.execute("insert into t values (1, 'x')")
    session.execute("vacuum t")
    plan = lambda sql: session.query(sql)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan("select a from t") and "HashAggregate" in plan("select b, count(*) from t group by b")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan("select a from t where a not in (select a from t where b = 'y')")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "LeftAnti" in found and "Broadcast" not in found
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_in_")]


def test_a_folder_that_only_hadoop_reads(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.quern.link./db", f"file://{tmp_path}")
    engine = Engine(spark, "viewfs://quern/db")
    session = engine.session()
    session.execute("create table t (a int primary key, b text)")
    session.execute("insert into t values (1, 'x')")
    session.execute("insert into t values (2, 'y')")
    session.execute("delete from t where a = 1")
    session.execute("vacuum t")
    assert Engine(spark, "viewfs://quern/db").session().execute("select a, b from t").rows() == [(2, "y")]
    session.save("viewfs://quern/db/saved")
    other = Engine(spark).session()
    other.load("viewfs://quern/db/saved")
    assert other.execute("select a from t").rows() == [(2,)]
