"""Seeded random statements over tables with NULLs, against DuckDB: three-valued logic, joins, grouping, subqueries."""

import random

import duckdb
import pytest

from quern import Engine


class Maker:
    def __init__(self, seed):
        self.chance = random.Random(seed)

    def pick(self, *choices):
        return self.chance.choice(choices)

    def number(self, q=""):
        c = self.chance.random()
        if c < 0.45:
            return q + self.pick("a", "b")
        if c < 0.7:
            return str(self.chance.randint(-3, 6))
        return f"({self.number(q)} {self.pick('+', '-', '*')} {self.number(q)})"

    def predicate(self, q="", depth=0):
        c = self.chance.random()
        if depth < 3 and c < 0.4:
            return f"({self.predicate(q, depth + 1)} {self.pick('and', 'or')} {self.predicate(q, depth + 1)})"
        if c < 0.5:
            return f"not {self.predicate(q, depth + 1)}" if depth < 3 else f"{q}a is null"
        if c < 0.6:
            return f"{self.number(q)} is {self.pick('', 'not ')}null"
        if c < 0.7:
            return f"{q}s {self.pick('', 'not ')}like '{self.pick('%', 'x%', '%y', '_', 'x_', '%z%')}'"
        if c < 0.8:
            return f"{q}a {self.pick('', 'not ')}in ({', '.join(self.pick('1', '2', '3', '5') for _ in range(3))}{self.pick('', ', NULL')})"
        if c < 0.87:
            return f"{q}b {self.pick('', 'not ')}in (select {self.pick('a', 'b')} from u where {self.pick('a > 1', 'b is not null', 's like ' + chr(39) + 'x%' + chr(39))})"
        if c < 0.92:
            return f"{q}a {self.pick('<', '=', '>=')} (select {self.pick('max(a)', 'min(b)', 'count(*)')} from u)"
        return f"{self.number(q)} {self.pick('=', '<>', '<', '<=', '>', '>=')} {self.number(q)}"

    def statement(self):
        kind = self.chance.randrange(5)
        if kind == 0:
            return f"select id, {self.number()} as n from t where {self.predicate()}"
        if kind == 1:
            return f"select x.id as i, y.id as j from t x {self.pick('join', 'left join')} u y on {self.pick('x.a = y.a', 'x.a = y.a and x.b < y.b', 'x.b > y.b')} where {self.predicate('x.')}"
        if kind == 2:
            return f"select s, count(*) as n, count(a) as c, sum(b) as t, min(a) as lo from t where {self.predicate()} group by s having count(*) > {self.chance.randint(0, 2)}"
        if kind == 3:
            return f"select distinct a, s from t where {self.predicate()}"
        return f"select count(*) as n, sum(a) as t, max(s) as m from t, u where t.a = u.a".replace("sum(a)", "sum(t.a)").replace("max(s)", "max(u.s)") + f" and {self.predicate('t.')}"


@pytest.fixture(scope="module")
def both(spark):
    session, oracle, chance = Engine(spark).session(), duckdb.connect(), random.Random(99)
    for table in ("t", "u"):
        sql = f"create table {table} (id int, a int, b int, s text)"
        session.execute(sql)
        oracle.execute(sql)
        for i in range(24):
            cells = [str(i), *(chance.choice(["NULL", "1", "2", "3", "5", "-2"]) for _ in range(2)), chance.choice(["NULL", "'x'", "'xy'", "'Y'", "'zz'", "''"])]
            sql = f"insert into {table} values ({', '.join(cells)})"
            session.execute(sql)
            oracle.execute(sql)
    return session, oracle


@pytest.mark.parametrize("seed", range(60))
def test_same_rows(both, seed):
    session, oracle = both
    sql = Maker(seed).statement()
    ours = sorted(map(str, session.execute(sql).rows()))
    assert ours == sorted(map(str, oracle.execute(sql).fetchall())), sql
