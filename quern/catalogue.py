"""The queries of the dialect on the supplied tables, each with its SQL for an independent engine.

A query's text goes through lexer, parser, binder and planner; the oracle's
text says the same in that engine's dialect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scripts
from quern.operators.query import Query
from quern.operators.storage import shared_folder
from quern.plans.parser import parse
from quern.session import Engine, Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

HIGH = "left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > {}"

# name: (our text, the oracle's text or None for the same)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "scan_star": ("select * from nation", None),
    "project_reorder": ("select n_name, n_nationkey from nation", None),
    "expr_arith_float": ("select l_orderkey, l_linenumber, l_extendedprice*(1.0-l_discount) as net from lineitem", "select l_orderkey, l_linenumber, l_extendedprice*(1e0-l_discount) as net from lineitem"),
    "expr_int_div_mod": ("select p_partkey, p_size/7 as q, p_size%7 as r, -p_size as neg from part", "select p_partkey, cast(p_size//7 as int) as q, p_size%7 as r, -p_size as neg from part"),
    "expr_null_propagation": (f"select o.o_orderkey+c.c_custkey as s from customer c {HIGH.format('400000.0')}", f"select o.o_orderkey+c.c_custkey as s from customer c {HIGH.format('400000e0')}"),
    "expr_literal": ("select 1 as one, 'x' as x, 2.5 as f from region", "select 1 as one, 'x' as x, 2.5e0 as f from region"),
    "where_cmp_eq": ("select o_orderkey from orders where o_orderstatus = 'F'", None),
    "where_cmp_ne": ("select o_orderkey from orders where o_orderstatus <> 'F'", None),
    "where_range_and": ("select l_orderkey, l_linenumber from lineitem where l_quantity >= 10.0 and l_quantity < 20.0 and l_discount > 0.05", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10e0 and l_quantity < 20e0 and l_discount > 0.05e0"),
    "where_or_not": ("select p_partkey from part where not (p_size < 10 or p_size > 40)", None),
    "where_expr_both_sides": ("select l_orderkey, l_linenumber from lineitem where l_quantity*2.0 > l_extendedprice/1000.0 + 50.0", "select l_orderkey, l_linenumber from lineitem where l_quantity*2e0 > l_extendedprice/1000e0 + 50e0"),
    "where_div_zero_unknown": ("select l_orderkey, l_linenumber from lineitem where l_extendedprice/l_discount > 500000.0", "select l_orderkey, l_linenumber from lineitem where l_extendedprice/nullif(l_discount,0) > 500000e0"),
    "where_error_is_null": ("select p_partkey from part where p_size/(p_size%5) is not null", "select p_partkey from part where p_size%5 <> 0"),
    "where_date_literal": ("select o_orderkey from orders where o_orderdate >= '1996-01-01'", "select o_orderkey from orders where cast(o_orderdate as date) >= date '1996-01-01'"),
    "where_is_null": (f"select c.c_custkey as k from customer c {HIGH.format('400000.0')} where o.o_orderkey is null", f"select c.c_custkey as k from customer c {HIGH.format('400000e0')} where o.o_orderkey is null"),
    "where_is_not_null": (f"select c.c_custkey as k from customer c {HIGH.format('400000.0')} where o.o_orderkey is not null", f"select c.c_custkey as k from customer c {HIGH.format('400000e0')} where o.o_orderkey is not null"),
    "where_in_list": ("select n_nationkey, n_name from nation where n_regionkey in (1, 3)", None),
    "where_not_in_list": ("select n_nationkey, n_name from nation where n_regionkey not in (1, 3)", None),
    "where_in_list_null": ("select n_nationkey from nation where n_regionkey in (1, NULL)", None),
    "where_not_in_list_null": ("select n_nationkey from nation where n_regionkey not in (1, NULL)", None),
    "like_prefix": ("select p_partkey from part where p_brand like 'Brand#1%'", None),
    "like_infix_suffix": ("select p_partkey from part where p_type like '%E%' and p_brand like '%1'", None),
    "like_underscore": ("select p_partkey from part where p_brand like 'Brand#_1'", None),
    "not_like": ("select p_partkey from part where p_type not like '%A%'", None),
    "distinct_cols": ("select distinct o_orderstatus, o_orderpriority from orders", None),
    "distinct_null_once": (f"select distinct o.o_orderstatus as s from customer c {HIGH.format('300000.0')}", f"select distinct o.o_orderstatus as s from customer c {HIGH.format('300000e0')}"),
    "order_by_limit_topn": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", None),
    "order_by_nulls_first": (f"select c.c_custkey as k, o.o_orderkey as ok from customer c {HIGH.format('400000.0')} order by ok, k limit 20", f"select c.c_custkey as k, o.o_orderkey as ok from customer c {HIGH.format('400000e0')} order by ok nulls first, k limit 20"),
    "order_by_expr_label": ("select l_orderkey, l_linenumber, l_quantity*l_extendedprice as v from lineitem order by v desc, l_orderkey, l_linenumber limit 25", None),
    "limit_zero": ("select * from region limit 0", None),
    "agg_global": ("select count(*) as n, count(value) as nv, min(event_id) as mn, max(event_type) as mx, avg(value) as av from events", None),
    "agg_empty": ("select count(*) as n, sum(p_size) as s, avg(p_size) as a, min(p_name) as mn, max(p_size) as mx from part where p_size > 1000000", "select count(*) as n, cast(sum(p_size) as bigint) as s, avg(p_size) as a, min(p_name) as mn, max(p_size) as mx from part where p_size > 1000000"),
    "agg_int_sum": ("select sum(p_size) as s from part", "select cast(sum(p_size) as bigint) as s from part"),
    "agg_expr": ("select sum(l_extendedprice*(1.0-l_discount)) as rev, avg(l_quantity*2.0) as aq, max(l_quantity+1.0) as mq from lineitem", "select sum(l_extendedprice*(1e0-l_discount)) as rev, avg(l_quantity*2e0) as aq, max(l_quantity+1e0) as mq from lineitem"),
    "agg_date_minmax": ("select min(o_orderdate) as lo, max(o_orderdate) as hi from orders", "select min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi from orders"),
    "group_single": ("select l_returnflag, count(*) as n, sum(l_quantity) as q from lineitem group by l_returnflag", None),
    "group_multi": ("select l_returnflag, l_linestatus, count(*) as n, avg(l_discount) as d from lineitem group by l_returnflag, l_linestatus", None),
    "group_null_key": (f"select o.o_orderstatus as s, count(*) as n from customer c {HIGH.format('300000.0')} group by o.o_orderstatus", f"select o.o_orderstatus as s, count(*) as n from customer c {HIGH.format('300000e0')} group by o.o_orderstatus"),
    "group_no_agg": ("select p_brand from part group by p_brand", None),
    "group_many": ("select l_orderkey, count(*) as n from lineitem group by l_orderkey", None),
    "having_count": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", None),
    "having_and_or_key": ("select o_orderstatus, count(*) as n, sum(o_totalprice) as s from orders group by o_orderstatus having count(*) > 10 and sum(o_totalprice) > 1000.0 or o_orderstatus = 'F'", "select o_orderstatus, count(*) as n, sum(o_totalprice) as s from orders group by o_orderstatus having count(*) > 10 and sum(o_totalprice) > 1000e0 or o_orderstatus = 'F'"),
    "having_global": ("select count(*) as n from orders having count(*) > 1", None),
    "join_inner_equi": ("select c.c_name as c_name, o.o_orderkey as o_orderkey from customer c join orders o on c.c_custkey = o.o_custkey", None),
    "join_comma_where": ("select n.n_name as n_name, r.r_name as r_name from nation n, region r where n.n_regionkey = r.r_regionkey", None),
    "join_cross": ("select count(*) as n from nation, region", None),
    "join_theta": ("select count(*) as n from nation a, nation b where a.n_nationkey < b.n_nationkey", None),
    "join_or_nestedloop": ("select count(*) as n from nation n, region r where n.n_regionkey = r.r_regionkey or n.n_nationkey = 5", None),
    "join_self_alias": ("select a.n_name as x, b.n_name as y from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_three_way": ("select n.n_name as n_name, count(*) as c from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where r.r_name = 'ASIA' group by n.n_name", None),
    "join_left": ("select c.c_custkey as k, o.o_orderkey as ok from customer c left join orders o on c.c_custkey = o.o_custkey", None),
    "join_left_on_vs_where": (f"select c.c_custkey as k, o.o_orderkey as ok from customer c {HIGH.format('200000.0')}", f"select c.c_custkey as k, o.o_orderkey as ok from customer c {HIGH.format('200000e0')}"),
    "join_left_where_filter": ("select c.c_custkey as k, o.o_orderkey as ok from customer c left join orders o on c.c_custkey = o.o_custkey where o.o_totalprice > 200000.0", "select c.c_custkey as k, o.o_orderkey as ok from customer c left join orders o on c.c_custkey = o.o_custkey where o.o_totalprice > 200000e0"),
    "join_left_count_col": ("select c.c_custkey as k, count(o.o_orderkey) as n from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey", None),
    "join_left_chain": ("select r.r_name as r, n.n_name as n, s.s_name as s from region r left join nation n on r.r_regionkey = n.n_regionkey left join supplier s on n.n_nationkey = s.s_nationkey", None),
    "sub_in": ("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000.0)", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000e0)"),
    "sub_not_in": ("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000.0)", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000e0)"),
    "sub_not_in_null": (f"select n_nationkey from nation where n_nationkey not in (select o.o_custkey from customer c {HIGH.format('470000.0')})", f"select n_nationkey from nation where n_nationkey not in (select o.o_custkey from customer c {HIGH.format('470000e0')})"),
    "sub_exists": ("select r_name from region where exists (select o_orderkey from orders where o_totalprice > 1.0)", "select r_name from region where exists (select o_orderkey from orders where o_totalprice > 1e0)"),
    "sub_not_exists": ("select r_name from region where not exists (select o_orderkey from orders where o_totalprice > 1000000000000.0)", "select r_name from region where not exists (select o_orderkey from orders where o_totalprice > 1e12)"),
    "sub_scalar_eq": ("select o_orderkey from orders where o_totalprice = (select max(o_totalprice) from orders)", None),
    "sub_scalar_lt_avg": ("select o_orderkey from orders where o_totalprice < (select avg(o_totalprice) from orders)", None),
    "sub_scalar_empty": ("select o_orderkey from orders where o_totalprice = (select o_totalprice from orders where o_orderkey < 0)", None),
    "sub_nested": ("select c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > (select avg(o_totalprice) from orders))", None),
    "sub_in_under_or": ("select n_name from nation where n_nationkey < 3 or n_regionkey in (select r_regionkey from region where r_name like 'A%')", None),
}

FLAGSHIP = """select n.n_name as n_name, count(*) as c, sum(o.o_totalprice) as s from customer c join nation n on c.c_nationkey = n.n_nationkey
    join orders o on o.o_custkey = c.c_custkey where o.o_totalprice > 1000.0 group by n.n_name having count(*) > 1 order by s desc limit 10"""
FLAGSHIP_ORACLE = FLAGSHIP.replace("1000.0", "1000e0")
STATEMENTS["flagship"] = (FLAGSHIP, FLAGSHIP_ORACLE)


# Decimals of sums and averages of floats, which depend on the order of addition.
ROUNDED = {
    "flagship": {"s": 2}, "agg_global": {"av": 6}, "agg_expr": {"rev": 2, "aq": 6}, "group_single": {"q": 2}, "group_multi": {"d": 6},
    "having_and_or_key": {"s": 2},
}


def opened(spark: SparkSession, sf_dir: str) -> Session:
    engine = Engine(spark)
    engine.register_parquet(sf_dir, list(TABLES))
    return engine.session()


def _statement(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = opened(spark, sf_dir).query(text)
        return frame.withColumns({c: F.round(c, n) for c, n in ROUNDED[name].items()}) if name in ROUNDED else frame

    return run


def _oracle(name: str, text: str) -> str:
    if name not in ROUNDED:
        return text
    rounded = ", ".join(f"round({c}, {n}) as {c}" for c, n in ROUNDED[name].items())
    return f"select * replace ({rounded}) from ({text})"


def _copied(session: Session, table: str, create: str) -> Session:
    """A stored table with a registered one's rows."""
    from quern.streaming import append

    session.execute(create)
    append(session, create.split()[2], session.query(f"select * from {table}"))
    return session


PART = "create table mypart (p_partkey bigint primary key, p_name text, p_brand varchar(12) not null, p_type text, p_size int check (p_size > 0), p_retailprice float)"
SUPPLIER = "create table mysupp (s_suppkey bigint, s_name text, s_nationkey int, s_acctbal float)"


def dml_update_as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "part", PART)
    session.execute("update mypart set p_size = p_size*2, p_name = p_brand where p_size%3 = 0 and p_type like '%A%'")
    return session.query("select p_partkey, p_name, p_size from mypart")


def dml_delete_as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "part", PART)
    session.execute("delete from mypart where p_size < 20 or p_brand in (select p_brand from part where p_size = 50)")
    return session.query("select p_partkey, p_size from mypart")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.execute("create table n2 (k int primary key, name text, note text default 'none')")
    session.execute("begin")
    for k in range(40):
        session.execute(f"insert into n2 (k, name) values ({k}, 'N{k * k}')")
    session.execute("insert into n2 values (-1, NULL, 'it''s')")
    session.execute("commit")
    return session.query("select k, name, note from n2")


def ddl_add_column_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("alter table mysupp add column grade text default 'new'")
    return session.query("select s_suppkey, grade from mysupp")


def ddl_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("alter table mysupp drop column s_name")
    return session.query("select * from mysupp")


def ddl_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("alter table mysupp rename column s_name to label")
    session.execute("alter table mysupp rename to vendors")
    return session.query("select s_suppkey, label from vendors")


def ddl_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("create index by_nation on mysupp (s_nationkey)")
    return session.query("select s_suppkey from mysupp where s_nationkey >= 20")


def constraint_check_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers one by one into a table with a CHECK: those that it lets in."""
    session = opened(spark, sf_dir)
    session.execute("create table ok (k bigint primary key, bal float, nation int, check (bal > 0.0 or nation < 5))")
    rows = session.execute("select s_suppkey, s_acctbal, s_nationkey from supplier order by s_suppkey limit 60").rows()
    session.script(f"insert into ok values ({k}, {bal!r}, {nation})" for k, bal, nation in rows)
    return session.query("select k, bal, nation from ok")


def constraint_unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers one by one into a table with a unique nation: of each nation the first gets in."""
    session = opened(spark, sf_dir)
    session.execute("create table first (nation int unique, k bigint not null)")
    rows = session.execute("select c_nationkey, c_custkey from customer order by c_custkey limit 80").rows()
    session.script(f"insert into first values ({nation}, {k})" for nation, k in rows)
    return session.query("select nation, k from first")


def txn_rollback_is_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("begin")
    session.execute("update mysupp set s_acctbal = 0.0")
    session.execute("delete from mysupp where s_suppkey < 50")
    session.execute("rollback")
    return session.query("select s_suppkey, s_acctbal from mysupp")


def db_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    for sql in ("create database side", "use side", "create table part (x int, s text)", "insert into part values (2, 'side')", "use main"):
        session.execute(sql)
    there, here = engine_session(session, "side"), session
    return here.query("select p_partkey as k, p_name as s from part where p_partkey < 20").unionByName(there.query("select x as k, s from part").selectExpr("cast(k as bigint) as k", "s"))


def engine_session(session: Session, database: str) -> Session:
    """Another session of the same engine, in another database."""
    other = session.engine.session()
    other.execute(f"use {database}")
    return other


def vacuum_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    session.execute("delete from mysupp where s_nationkey = 3")
    session.execute("vacuum mysupp")
    return session.query("select s_suppkey from mysupp")


def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _copied(opened(spark, sf_dir), "supplier", SUPPLIER)
    folder = f"{shared_folder(spark)}/save-{uuid.uuid4().hex}"
    session.save(folder)
    other = Engine(spark).session()
    other.load(folder)
    return other.query("select s_suppkey, s_name, s_acctbal from mysupp")


def prepared_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.prepare("pick", "select p_partkey from part where p_size > $1 and p_brand like $2")
    return session.run("pick", [40, "Brand#2%"]).frame


def fluent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Query(opened(spark, sf_dir), "customer", "c").join("orders", "c.c_custkey = o.o_custkey", "o").where("o.o_totalprice > 250000.0")
    return query.group_by("c.c_nationkey").agg("c.c_nationkey k", "count(*) n").having("n > 1").frame()


WORK: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_update_as_select": (dml_update_as_select, "select p_partkey, case when p_size%3 = 0 and p_type like '%A%' then p_brand else p_name end as p_name, case when p_size%3 = 0 and p_type like '%A%' then p_size*2 else p_size end as p_size from part"),
    "dml_delete_as_select": (dml_delete_as_select, "select p_partkey, p_size from part where not (p_size < 20 or p_brand in (select p_brand from part where p_size = 50))"),
    "dml_insert": (dml_insert, "select cast(i as int) as k, 'N' || cast(i*i as varchar) as name, 'none' as note from range(40) r(i) union all select -1, null, 'it''s'"),
    "ddl_add_column_default": (ddl_add_column_default, "select s_suppkey, 'new' as grade from supplier"),
    "ddl_drop_column": (ddl_drop_column, "select s_suppkey, s_nationkey, s_acctbal from supplier"),
    "ddl_rename": (ddl_rename, "select s_suppkey, s_name as label from supplier"),
    "ddl_index_scan": (ddl_index_scan, "select s_suppkey from supplier where s_nationkey >= 20"),
    "constraint_check_filter": (constraint_check_filter, "select s_suppkey as k, s_acctbal as bal, s_nationkey as nation from (select * from supplier order by s_suppkey limit 60) where s_acctbal > 0 or s_nationkey < 5"),
    "constraint_unique_violations": (constraint_unique_violations, "select c_nationkey as nation, min(c_custkey) as k from (select * from customer order by c_custkey limit 80) group by c_nationkey"),
    "txn_rollback_is_identity": (txn_rollback_is_identity, "select s_suppkey, s_acctbal from supplier"),
    "db_namespaces": (db_namespaces, "select p_partkey as k, p_name as s from part where p_partkey < 20 union all select 2, 'side'"),
    "vacuum_keeps_rows": (vacuum_keeps_rows, "select s_suppkey from supplier where s_nationkey <> 3"),
    "save_load_roundtrip": (save_load_roundtrip, "select s_suppkey, s_name, s_acctbal from supplier"),
    "prepared_parameters": (prepared_parameters, "select p_partkey from part where p_size > 40 and p_brand like 'Brand#2%'"),
    "fluent_query": (fluent_query, "select c_nationkey as k, count(*) as n from customer join orders on c_custkey = o_custkey where o_totalprice > 250000 group by c_nationkey having count(*) > 1"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(name, ours) for name, (ours, _) in STATEMENTS.items()} | {name: work for name, (work, _) in WORK.items()} | scripts.QUERIES
ORACLE: dict[str, str] = {name: _oracle(name, theirs or ours) for name, (ours, theirs) in STATEMENTS.items()} | {name: sql for name, (_, sql) in WORK.items()} | scripts.ORACLE

for _text, _ in STATEMENTS.values():  # a slip in a text shows when this is read
    parse(_text)
