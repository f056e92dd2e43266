"""Joins, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.joins import equi_join, semi_join
from sparkloom.queries.base import exact_sum, query
from sparkloom.sources.tables import views

C = F.col
_ORDERS_CUSTOMER = "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


def _orders_customer(t, strategy):
    return equi_join(t("orders"), t("customer"), [("o_custkey", "c_custkey")], strategy).select("o_orderkey", "c_name")


@query(_ORDERS_CUSTOMER)
def join_equi(t, spark, sf):
    return _orders_customer(t, None)


@query(_ORDERS_CUSTOMER)
def join_sort_merge(t, spark, sf):
    return _orders_customer(t, "merge")


@query(_ORDERS_CUSTOMER)
def join_hash(t, spark, sf):
    return _orders_customer(t, "hash")


@query(_ORDERS_CUSTOMER)
def join_broadcast(t, spark, sf):
    return _orders_customer(t, "broadcast")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def join_nl(t, spark, sf):
    return equi_join(t("supplier"), t("nation"), [("s_nationkey", "n_nationkey")], "nested_loops").select("s_suppkey", "n_name")


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey")
def join_multi_key(t, spark, sf):
    return equi_join(t("customer"), t("supplier"), [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")]).select("c_custkey", "s_suppkey")


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY'")
def join_bitmap_semi(t, spark, sf):
    return semi_join(t("orders"), t("customer").where(C("c_mktsegment") == "MACHINERY"), [("o_custkey", "c_custkey")]).select("o_orderkey", "o_totalprice")


@query("SELECT r.r_name, n.n_name FROM region r, nation n")
def join_cross(t, spark, sf):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
def join_implicit(t, spark, sf):
    views(spark, sf, "nation", "region")
    return spark.sql("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey")
def join_three_way(t, spark, sf):
    views(spark, sf, "customer", "nation", "region")
    return spark.sql("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey")


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l INNER JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 45 AND l.l_quantity < 5")
def join_on_filter(t, spark, sf):
    return t("lineitem").where(C("l_quantity") < 5).join(t("part").where(C("p_size") > 45), C("l_partkey") == C("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT l.l_orderkey, l.l_linenumber, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000")
def join_chain(t, spark, sf):
    big = t("orders").where(C("o_totalprice") > 300000)
    return t("lineitem").join(big, C("l_orderkey") == C("o_orderkey")).join(t("customer"), C("o_custkey") == C("c_custkey")).select("l_orderkey", "l_linenumber", "c_name")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural(t, spark, sf):
    return t("nation").select(C("n_regionkey").alias("k"), "n_name").join(t("region").select(C("r_regionkey").alias("k"), "r_name"), ["k"])


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(t, spark, sf):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_name").alias("one"), C("b.n_name").alias("other"))


def _nations(t, name, prefix):
    return t(name).select(C(f"{prefix}_nationkey").alias("k"))


_S, _K = "SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer"


@query(f"{_S} UNION {_K}")
def set_union_distinct(t, spark, sf):
    return _nations(t, "supplier", "s").union(_nations(t, "customer", "c")).distinct()


@query(f"{_S} UNION ALL {_K}")
def set_union_all(t, spark, sf):
    return _nations(t, "supplier", "s").union(_nations(t, "customer", "c"))


@query(f"{_K} EXCEPT ALL {_S}")
def set_except_all(t, spark, sf):
    return _nations(t, "customer", "c").exceptAll(_nations(t, "supplier", "s"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000")
def set_except_distinct(t, spark, sf):
    return t("customer").select(C("c_custkey").alias("k")).subtract(t("orders").where(C("o_totalprice") > 100000).select(C("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders")
def set_intersect(t, spark, sf):
    return t("customer").select(C("c_custkey").alias("k")).intersect(t("orders").select(C("o_custkey").alias("k")))


@query(f"({_S} UNION ALL {_K}) EXCEPT (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 INTERSECT SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 2)")
def set_chain(t, spark, sf):
    n = t("nation")
    away = n.where("n_regionkey = 1").select(C("n_nationkey").alias("k")).intersect(n.where("n_nationkey > 2").select(C("n_nationkey").alias("k")))
    return _nations(t, "supplier", "s").union(_nations(t, "customer", "c")).subtract(away)


def _same(sql: str, *tables: str):
    """A query whose text is the same for both engines."""

    def run(t, spark, sf):
        views(spark, sf, *tables)
        return spark.sql(sql)

    return run


def _register(name: str, sql: str, *tables: str) -> None:
    run = _same(sql, *tables)
    run.__name__ = name
    query(sql)(run)


_register("subquery_scalar_select", "SELECT r_name, (SELECT CAST(count(*) AS BIGINT) FROM nation) AS nations FROM region", "region", "nation")
_register("subquery_from", "SELECT x.n_name FROM (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 10) x WHERE x.n_regionkey = 2", "nation")
_register("subquery_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer", "orders")
_register("subquery_scalar_where", "SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)", "part")
_register("subquery_nested", "SELECT c_name FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1))", "customer", "nation", "region")
_register(
    "subquery_double_agg",
    f"SELECT c.c_custkey, a.n_orders, b.spent FROM customer c JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey JOIN (SELECT o_custkey, {exact_sum('o_totalprice')} AS spent FROM orders GROUP BY o_custkey) b ON c.c_custkey = b.o_custkey",
    "customer", "orders",
)
_register(
    "complex_combined",
    "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT n_nationkey AS k, n_regionkey FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_acctbal FROM customer) WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY n_regionkey HAVING n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 4) ORDER BY n_regionkey",
    "nation", "customer", "region",
)
