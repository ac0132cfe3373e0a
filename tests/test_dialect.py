"""The dialect's rules on small tables of our own."""

import datetime

import pytest

from quern import Engine, EngineError


@pytest.fixture(scope="module")
def session(spark):
    s = Engine(spark).session()
    for sql in (
        "create table crew (id int, name text, ship int, pay float, joined date)",
        "insert into crew values (1, 'Ann', 10, 12.5, '2020-02-29')",
        "insert into crew values (2, 'bob', 20, NULL, '2021-01-01')",
        "insert into crew values (3, NULL, 10, -3.0, NULL)",
        "insert into crew values (4, 'Cy_d', NULL, 40.0, '2019-07-04')",
        "create table ships (id int, label text)",
        "insert into ships values (10, 'Argo')",
        "insert into ships values (30, 'Beagle')",
        "insert into ships values (NULL, 'ghost')",
        "create table nums (a int, b int, f float)",
        "insert into nums values (7, 2, 0.0)",
        "insert into nums values (-7, 0, 2.0)",
        "insert into nums values (2147483647, 1, NULL)",
        "insert into nums values (NULL, 3, 1.5)",
    ):
        s.execute(sql)
    return s


def rows(session, sql, parameters=None):
    return session.execute(sql, parameters).rows()


def code(session, sql):
    with pytest.raises(EngineError) as caught:
        session.execute(sql).rows()
    return caught.value.code


def test_three_valued_logic(session):
    assert rows(session, "select id from crew where name = 'Ann' or pay > 1.0 order by id") == [(1,), (4,)]
    assert rows(session, "select id from crew where not (pay > 0.0) order by id") == [(3,)]
    assert rows(session, "select id from crew where name is null") == [(3,)]
    assert rows(session, "select id from crew where name is not null and not name like 'A%' order by id") == [(2,), (4,)]
    assert rows(session, "select id from crew where ship in (10, NULL) order by id") == [(1,), (3,)]
    assert rows(session, "select id from crew where ship not in (10, NULL)") == []
    assert rows(session, "select id from crew where ship not in (10) order by id") == [(2,)]


def test_like_has_no_escape(session):
    assert rows(session, "select id from crew where name like '%_%' order by id") == [(1,), (2,), (4,)]
    assert rows(session, "select id from crew where name like 'B%'") == []
    assert rows(session, r"select id from crew where name like 'a\b'") == []
    assert rows(session, "select id from crew where name not like '_nn' order by id") == [(2,), (4,)]


def test_order_and_limit(session):
    assert [r[0] for r in rows(session, "select id, pay from crew order by pay")] == [2, 3, 1, 4]
    assert [r[0] for r in rows(session, "select id, pay from crew order by pay desc")] == [4, 1, 3, 2]
    assert rows(session, "select id from crew limit 2") == [(1,), (2,)]
    assert rows(session, "select id from crew limit 0") == []
    assert rows(session, "select distinct ship from crew") == [(10,), (20,), (None,)]
    assert rows(session, "select pay*2 from crew order by pay*2 desc limit 1") == [(80.0,)]


def test_labels(session):
    head = lambda sql: session.execute(sql).headers
    assert head("select a+b*2, (a+b)*2, -a, - -a, 'x' from nums") == ["a+(b*2)", "(a+b)*2", "-a", "--a", "x"]
    assert head("select NAME, crew.id n from crew") == ["name", "n"]
    assert head("select * from crew c limit 1") == ["c.id", "c.name", "c.ship", "c.pay", "c.joined"]
    assert head("select count(*), sum(pay*2.0) from crew") == ["count(*)", "sum(pay*2)"]


def test_arithmetic(session):
    assert rows(session, "select a/2, a%2, -a from nums where a < 10 order by a/2") == [(-3, -1, 7), (3, 1, -7)]
    assert rows(session, "select a+b from nums where a is null") == [(None,)]
    assert code(session, "select a/b from nums") == 415
    assert code(session, "select a%b from nums") == 415
    assert code(session, "select 1.0/f from nums") == 415
    assert code(session, "select a+b from nums") == 103
    assert code(session, "select f%2.0 from nums") == 303
    assert rows(session, "select a/b from nums where b > 5") == []


def test_errors_in_predicates_are_unknown(session):
    assert rows(session, "select a from nums where a/b > 0 and a < 10") == [(7,)]
    assert rows(session, "select a from nums where not a/b > 100 order by a") == [(7,)]
    assert rows(session, "select a from nums where a+b > 5 order by a") == [(7,)]
    assert rows(session, "select b from nums where a/b is null") == [(3,)]
    assert rows(session, "select b from nums where a/b is not null order by b") == [(1,), (2,)]
    assert rows(session, "select b from nums where f%2.0 = 0.0") == []


def test_types_are_strict(session):
    for sql in (
        "select id from crew where id = 'x'",
        "select id from crew where id > 2.5",
        "select id from crew where id = pay",
        "select id from crew where name > 1",
        "select id from crew where id like '1'",
        "select sum(name) from crew",
        "select name+1 from crew",
        "update crew set pay = id",
        "insert into crew values (1.5, 'x', 1, 1.0, NULL)",
    ):
        assert code(session, sql) == 303, sql
    assert rows(session, "select id from crew where pay > 12 order by id") == [(1,), (4,)]
    assert rows(session, "select id from crew where joined >= '2020-01-01' order by id") == [(1,), (2,)]
    for bad in ("2021-02-29", "2021-1-1", "x"):
        assert code(session, f"select id from crew where joined = '{bad}'") == 317


def test_aggregates(session):
    assert rows(session, "select count(*), count(pay), sum(pay), min(name), max(joined), avg(id) from crew") == [
        (4, 3, 49.5, "Ann", datetime.date(2021, 1, 1), 2.5)
    ]
    assert rows(session, "select count(*), sum(id), min(name) from crew where id > 99") == [(0, None, None)]
    assert rows(session, "select ship, count(*) from crew group by ship order by ship") == [(None, 1), (10, 2), (20, 1)]
    assert rows(session, "select ship, count(*) from crew group by ship") == [(10, 2), (20, 1), (None, 1)]
    assert rows(session, "select ship, count(*) as n from crew group by ship having n > 1") == [(10, 2)]
    assert rows(session, "select ship, count(*) as n from crew group by ship having count(*) > 1 and ship = 10") == [(10, 2)]
    assert rows(session, "select ship, avg(pay) from crew group by ship having avg(pay) > 4") == [(10, 4.75), (None, 40.0)]
    assert rows(session, "select ship from crew group by ship order by ship") == [(None,), (10,), (20,)]
    assert rows(session, "select sum(a) from nums") == [(2147483647,)]


def test_grouping_rules(session):
    assert code(session, "select name, count(*) from crew group by ship") == 306
    assert code(session, "select * from crew group by ship") == 306
    assert code(session, "select id from crew having id > 1") == 309
    assert code(session, "select ship, count(*) from crew group by ship having pay > 1.0") == 302


def test_joins(session):
    assert rows(session, "select c.id, s.label from crew c, ships s where c.ship = s.id") == [(1, "Argo"), (3, "Argo")]
    assert rows(session, "select c.id, label from crew c join ships s on c.ship = s.id and c.id > 1") == [(3, "Argo")]
    assert rows(session, "select c.id, s.label from crew c left join ships s on c.ship = s.id") == [(1, "Argo"), (2, None), (3, "Argo"), (4, None)]
    assert rows(session, "select c.id from crew c left join ships s on c.ship = s.id where s.id is null") == [(2,), (4,)]
    assert rows(session, "select c.id, s.label from crew c left join ships s on c.ship = s.id and s.label = 'x' where c.id < 3") == [(1, None), (2, None)]
    assert rows(session, "select count(*) from crew, ships") == [(12,)]
    assert rows(session, "select a.id, b.id from crew a, crew b where a.id < b.id and a.ship = b.ship") == [(1, 3)]
    assert rows(session, "select a.id, b.id, s.label from crew a join crew b on a.ship = b.ship left join ships s on b.ship = s.id where a.id = 1") == [(1, 1, "Argo"), (1, 3, "Argo")]
    assert code(session, "select id from crew, ships") == 313
    assert code(session, "select crew.id from crew, crew") == 314
    assert code(session, "select crew.id from crew c") == 302
    assert code(session, "select c.id from crew c join ships s") == 214
    assert code(session, "select c.id from crew c left join ships s on s.id = n.a left join nums n on n.a = c.id") == 302


def test_subqueries(session):
    assert rows(session, "select id from crew where ship in (select id from ships) order by id") == [(1,), (3,)]
    assert rows(session, "select id from crew where ship not in (select id from ships)") == []
    assert rows(session, "select id from crew where ship not in (select id from ships where id is not null)") == [(2,)]
    assert rows(session, "select id from crew where id = 4 or not ship in (select id from ships where id > 15)") == [(1,), (2,), (3,), (4,)]
    assert rows(session, "select id from crew where exists (select id from ships) and id < 2") == [(1,)]
    assert rows(session, "select id from crew where not exists (select id from ships where id > 99) order by id limit 1") == [(1,)]
    assert rows(session, "select id from crew where id = (select max(id) from crew)") == [(4,)]
    assert rows(session, "select id from crew where id < (select avg(id) from crew) order by id") == [(1,), (2,)]
    assert rows(session, "select id from crew where id = (select id from ships where id < 0)") == []
    assert rows(session, "select ship, count(*) as n from crew group by ship having n >= (select count(*) from ships where id = 10) and ship in (select id from ships)") == [(10, 2)]
    assert rows(session, "select c.id, s.label from crew c left join ships s on c.ship = s.id and c.id in (select max(id) from crew where id < 4) order by c.id limit 3") == [(1, None), (2, None), (3, "Argo")]
    assert code(session, "select id from crew where id = (select id from ships)") == 417
    assert code(session, "select id from crew where id in (select id, label from ships)") == 322
    assert code(session, "select id from crew where id in (select s.id from ships s where s.label = name)") == 321
    assert code(session, "select id from crew where name in (select id from ships)") == 303


def test_names_and_syntax(session):
    for number, sql in {
        100: "select id from crew where id = #", 101: "select 'x from crew", 200: "explode", 201: "select id crew x y", 202: "select id from",
        203: "create table t (", 204: "create table t (a blob)", 205: "create table t (a int", 206: "select id from crew where id = 1 1", 208: "insert into crew (id) (1)",
        209: "select id from crew limit -1", 210: "select id from crew where id", 211: "select id from crew order id", 212: "select upper(name) from crew",
        213: "select id from crew where name = NULL", 215: "update crew id = 1", 216: "update crew set id 1", 219: "create table t (a int primary)",
        220: "create table t (a varchar(0))", 222: "alter crew add x int", 223: "alter table crew rename column id two",
        300: "select x from nowhere", 302: "select nope from crew", 311: "use nowhere", 308: "drop index nothing",
    }.items():
        assert code(session, sql) == number, sql
    assert code(session, "select id from crew limit 2.5") == 209
    assert code(session, "select id from crew order by 1") == 302
    assert rows(session, "SELECT Id FROM CREW WHERE iD=1; -- end") == [(1,)]
    assert rows(session, "select label from ships where label = 'it''s'") == []


def test_parameters(session):
    assert rows(session, "select id from crew where name = $1 and id < $2", ["Ann", 3]) == [(1,)]
    assert session.prepare("by_pay", "select id from crew where pay > $1 order by id limit $2") == 2
    assert session.run("by_pay", [0.5, 1]).rows() == [(1,)]
