"""Aggregation, duplicate elimination and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.access import ranked
from sparkloom.plans.sql import Session
from sparkloom.queries.base import exact_sum, query

C = F.col


def total(column: str):
    return F.sum(C(column).cast("decimal(18,2)")).cast("double")


@query(f"SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, {exact_sum('l_quantity')} AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t, spark, sf):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), total("l_quantity").alias("qty"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, {exact_sum('o_totalprice')} AS price FROM orders")
def agg_global(t, spark, sf):
    return t("orders").agg(F.count("*").alias("n"), total("o_totalprice").alias("price"))


@query("SELECT p_brand, round(avg(p_size), 6) AS size FROM part GROUP BY p_brand")
def agg_avg(t, spark, sf):
    return t("part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size"))


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand")
def agg_sum(t, spark, sf):
    return t("part").groupBy("p_brand").agg(F.sum("p_size").alias("size"))


@query("SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
def agg_min_max(t, spark, sf):
    return t("customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("SELECT o_orderpriority, CAST(count(o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def agg_count(t, spark, sf):
    return t("orders").groupBy("o_orderpriority").agg(F.count("o_custkey").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def agg_count_star(t, spark, sf):
    return t("events").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand, p_size")
def agg_group_multi(t, spark, sf):
    return t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(s_acctbal) AS high FROM supplier GROUP BY GROUPING SETS (())")
def agg_grouping_empty(t, spark, sf):
    return t("supplier").groupBy().agg(F.count("*").alias("n"), F.max("s_acctbal").alias("high"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(t, spark, sf):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def having_as_where(t, spark, sf):
    """HAVING without groups or aggregates selects rows."""
    return Session(spark, {"supplier": t("supplier")}).run("SELECT s_suppkey, s_acctbal FROM supplier HAVING s_acctbal > 5000")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t, spark, sf):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users, event_type FROM events GROUP BY event_type")
def bitmap_distinct_count(t, spark, sf):
    """Distinct positions as bitmaps of fixed size, merged by bucket: what a bitmap index counts."""
    u = C("user_id")
    maps = t("events").groupBy("event_type", F.bitmap_bucket_number(u).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(u)).alias("bits"))
    return maps.groupBy("event_type").agg(F.sum(F.bitmap_count("bits")).alias("users"))


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS position FROM orders")
def sort_asc(t, spark, sf):
    return ranked(t("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", True)])


@query("SELECT p_partkey, p_size, p_brand, CAST(row_number() OVER (ORDER BY p_size, p_brand, p_partkey) AS BIGINT) AS position FROM part")
def sort_multi(t, spark, sf):
    return ranked(t("part").select("p_partkey", "p_size", "p_brand"), [("p_size", True), ("p_brand", True), ("p_partkey", True)])


@query("SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey DESC) AS BIGINT) AS position FROM customer")
def sort_mixed_desc(t, spark, sf):
    return ranked(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), [("c_nationkey", False), ("c_acctbal", True), ("c_custkey", False)])
