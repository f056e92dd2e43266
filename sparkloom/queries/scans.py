"""Scans, projections and predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sparkloom.functions.dates import between_symmetric, time_of_day
from sparkloom.queries.base import query

C = F.col


@query("SELECT * FROM nation")
def scan_full(t, spark, sf):
    return t("nation")


@query("SELECT c.c_custkey, c.c_name FROM customer AS c")
def scan_alias(t, spark, sf):
    return t("customer").alias("c").select("c.c_custkey", "c.c_name")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def scan_count(t, spark, sf):
    return t("lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def index_filter_eq(t, spark, sf):
    return t("orders").where(C("o_custkey") == 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_name, c_acctbal FROM customer")
def project_cols(t, spark, sf):
    return t("customer").select("c_name", "c_acctbal")


@query("SELECT s_suppkey AS id, s_name AS label FROM supplier")
def project_alias(t, spark, sf):
    return t("supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("label"))


@query("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def project_star_qualified(t, spark, sf):
    return t("nation").alias("n").join(t("region").alias("r"), C("n.n_regionkey") == C("r.r_regionkey")).select("n.*", "r.r_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(t, spark, sf):
    return t("customer").where(C("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_neq(t, spark, sf):
    return t("customer").where(C("c_mktsegment") != "BUILDING").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def filter_lt(t, spark, sf):
    return t("part").where(C("p_size") < 10).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 10")
def filter_le(t, spark, sf):
    return t("part").where(C("p_size") <= 10).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def filter_gt(t, spark, sf):
    return t("part").where(C("p_size") > 40).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
def filter_ge(t, spark, sf):
    return t("part").where(C("p_size") >= 40).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def filter_and(t, spark, sf):
    return t("lineitem").where((C("l_quantity") > 45) & (C("l_discount") < 0.03)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 OR c_acctbal < 0")
def filter_or(t, spark, sf):
    return t("customer").where((C("c_acctbal") > 9000) | (C("c_acctbal") < 0)).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey FROM part WHERE NOT p_size > 5")
def filter_not(t, spark, sf):
    return t("part").where(~(C("p_size") > 5)).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_'")
def filter_like(t, spark, sf):
    return t("customer").where(C("c_name").like("%1_")).select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(t, spark, sf):
    return t("nation").where(C("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey > l_partkey")
def filter_col_col(t, spark, sf):
    return t("lineitem").where(C("l_suppkey") > C("l_partkey")).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT p_partkey FROM part WHERE 30 > p_size")
def filter_literal_first(t, spark, sf):
    return t("part").where(F.lit(30) > C("p_size")).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 4.1")
def filter_mixed_numeric(t, spark, sf):
    return t("part").where(C("p_size").cast("double") > 4.1).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
def filter_date(t, spark, sf):
    return t("orders").where(C("o_orderdate").cast("date") >= F.lit(date(1997, 1, 1))).select("o_orderkey")


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS at FROM events WHERE strftime(ts, '%H:%M:%S') < '06:30:00'")
def filter_time(t, spark, sf):
    return t("events").select("event_id", time_of_day(C("ts")).alias("at")).where(C("at") < "06:30:00")


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45 AND p_retailprice > 1000")
def filter_precedence(t, spark, sf):
    return t("part").where((C("p_size") < 5) | ((C("p_size") > 45) & (C("p_retailprice") > 1000))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t, spark, sf):
    return t("part").where(C("p_size").between(10, 20)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN least(20, 10) AND greatest(20, 10)")
def filter_between_symmetric(t, spark, sf):
    return t("part").where(between_symmetric(C("p_size"), 20, 10)).select("p_partkey")
