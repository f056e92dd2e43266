"""Keyed and ordered access, data changes, dates and casts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.functions import dates
from sparkloom.functions.hashing import tuple_hash
from sparkloom.operators import access, hashed
from sparkloom.plans.sql import Session
from sparkloom.queries.base import query
from sparkloom.sources.shared import fresh_path
from sparkloom.sources.tables import Files, bulk_load

C = F.col


@query("SELECT * FROM customer WHERE c_custkey = 42")
def lookup_by_key(t, spark, sf):
    return access.lookup(t("customer"), c_custkey=42)


@query("SELECT * FROM supplier WHERE s_suppkey = 3")
def hash_lookup_eq(t, spark, sf):
    return access.lookup(t("supplier"), s_suppkey=3)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def composite_key_lookup(t, spark, sf):
    return access.lookup(t("lineitem"), l_orderkey=7, l_linenumber=1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000")
def btree_range_scan(t, spark, sf):
    return access.range_from(t("orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS position FROM orders")
def btree_ordered_scan(t, spark, sf):
    return access.ranked(t("orders").select("o_orderkey"), [("o_orderkey", True)])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT o_custkey FROM orders)")
def set_contains(t, spark, sf):
    return access.members(t("orders"), "o_custkey", t("supplier"), "s_suppkey").select("s_suppkey")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(t, spark, sf):
    return access.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT CAST(count(*) AS BIGINT) AS loaded FROM part")
def bulk_load_count(t, spark, sf):
    path = fresh_path(spark, "bulk-load")
    return spark.createDataFrame([(bulk_load(t("part"), path),)], "loaded long")


@query("SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', NULL")
def dml_insert(t, spark, sf):
    n = t("nation")
    return access.insert(n, spark.range(1).select(F.lit(100).alias("n_nationkey"), F.lit("ATLANTIS").alias("n_name")))


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def dml_insert_select(t, spark, sf):
    n = t("nation")
    return access.insert(n, n.where("n_regionkey = 0").withColumn("n_nationkey", C("n_nationkey") + 100))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(t, spark, sf):
    return access.update(t("supplier"), C("s_acctbal") < 0, s_name=F.lit("debt"), s_acctbal=F.lit(0.0))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update_in(t, spark, sf):
    return access.update_in(t("customer"), "c_custkey", t("orders").where(C("o_totalprice") > 300000), "o_custkey", c_acctbal=F.lit(1.0))


@query("SELECT event_id, user_id FROM events WHERE NOT (event_type = 'click' AND strftime(ts, '%H:%M:%S') < '12:00:00')")
def dml_delete(t, spark, sf):
    return access.delete(t("events"), (C("event_type") == "click") & (dates.time_of_day(C("ts")) < "12:00:00")).select("event_id", "user_id")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) AS d FROM orders")
def date_add_days(t, spark, sf):
    return t("orders").select("o_orderkey", dates.add_days(C("o_orderdate").cast("date"), 45).alias("d"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS d FROM orders")
def date_add_months(t, spark, sf):
    return t("orders").select("o_orderkey", dates.add_months(C("o_orderdate").cast("date"), 1).alias("d"))


@query("SELECT event_id, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def date_add_hours(t, spark, sf):
    return t("events").select("event_id", F.date_format(dates.add_time(C("ts"), hours=5, minutes=30), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) + INTERVAL 1 MONTH AS DATE) + 3 AS d FROM orders")
def date_add_mixed(t, spark, sf):
    return t("orders").select("o_orderkey", dates.add_date(C("o_orderdate").cast("date"), years=1, months=1, days=3).alias("d"))


@query("SELECT c_custkey, CAST(CAST(c_custkey AS VARCHAR) AS INTEGER) AS i, CAST('1.5' AS DOUBLE) AS f, CAST('2001-02-03' AS DATE) AS d FROM customer")
def cast_parse(t, spark, sf):
    return t("customer").select("c_custkey", C("c_custkey").cast("string").cast("int").alias("i"), F.lit("1.5").cast("double").alias("f"), F.lit("2001-02-03").cast("date").alias("d"))


@query("SELECT event_id, strftime(ts + INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS at FROM events")
def date_add_milliseconds(t, spark, sf):
    return t("events").select("event_id", F.date_format(dates.add_milliseconds(C("ts"), 1500), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@query("SELECT event_id, strftime(ts + INTERVAL 1 YEAR + INTERVAL 2 MONTH + INTERVAL 3 DAY + INTERVAL 4 HOUR + INTERVAL 5 MINUTE + INTERVAL 6 SECOND, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def date_add_parts(t, spark, sf):
    return t("events").select("event_id", F.date_format(dates.add_parts(C("ts"), 1, 2, 3, 4, 5, 6), "yyyy-MM-dd HH:mm:ss").alias("at"))


def _hash_file(spark, df, key, kind, **sizes):
    path = fresh_path(spark, f"hash-{kind}")
    hashed.store(df, path, [key], kind, **sizes)
    return hashed.HashFile.open(spark, path)


@query("SELECT * FROM supplier WHERE s_suppkey = 3")
def hash_static(t, spark, sf):
    return _hash_file(spark, t("supplier"), "s_suppkey", "static", buckets=8).lookup(spark, 3)


@query("SELECT * FROM customer WHERE c_custkey = 42")
def hash_extendible(t, spark, sf):
    return _hash_file(spark, t("customer"), "c_custkey", "extendible", capacity=200).lookup(spark, 42)


@query("SELECT * FROM part WHERE p_partkey = 11")
def hash_linear(t, spark, sf):
    return _hash_file(spark, t("part"), "p_partkey", "linear", capacity=300).lookup(spark, 11)


@query("SELECT s_suppkey, s_name FROM supplier")
def hash_scan(t, spark, sf):
    return _hash_file(spark, t("supplier").select("s_suppkey", "s_name"), "s_suppkey", "linear", capacity=40).scan(spark)


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def tuple_hash_groups(t, spark, sf):
    """Tuples met by their hash."""
    flags = (C("l_returnflag"), C("l_linestatus"))
    met = t("lineitem").groupBy(tuple_hash(*flags).alias("h")).agg(F.min(F.struct(*flags)).alias("t"), F.count("*").alias("n"))
    return met.select("t.*", "n")


@query("SELECT 'parts' AS name, CAST(count(*) AS BIGINT) AS n_rows, false AS there FROM part")
def named_table(t, spark, sf):
    """A table that is created by name, read, copied to a temporary one and dropped."""
    files = Files(spark)
    n = files.temp(files.create("parts", t("part"))).count()
    files.drop("parts")
    files.close()
    try:
        files.open("parts")
        there = True
    except AnalysisException:
        there = False
    return spark.createDataFrame([("parts", n, there)], "name string, n_rows long, there boolean")


_CRUISE = """
CREATE TABLE port (id INTEGER PRIMARY KEY, name VARCHAR(20) UNIQUE, opened DATE);
CREATE TABLE call (port_id INTEGER REFERENCES port, at TIME, logged TIMESTAMP, fee DOUBLE, FOREIGN KEY (port_id) REFERENCES port (id));
CREATE INDEX call_port USING EHASH ON call (port_id);
CREATE UNIQUE INDEX port_name ON port USING BTREE (name(10) ASC, id DESC);
CREATE TABLE gone (a INTEGER);
CREATE INDEX gone_a USING LHASH ON gone (a);
DROP INDEX gone_a;
DROP TABLE gone;
"""


@query("SELECT table_name, CAST(n_rows AS BIGINT) AS n_rows, n_columns FROM (VALUES ('port', 0, 3), ('call', 0, 4)) AS v(table_name, n_rows, n_columns)")
def ddl_tables(t, spark, sf):
    session = Session(spark)
    session.script(_CRUISE)
    return session.run("SELECT table_name, n_rows, n_columns FROM sys_tables")


@query("""SELECT * FROM (VALUES ('port', 'id', 0, 'INT', 4), ('port', 'name', 1, 'VARCHAR', 20), ('port', 'opened', 2, 'DATE', 3),
    ('call', 'port_id', 0, 'INT', 4), ('call', 'at', 1, 'TIME', 5), ('call', 'logged', 2, 'DATETIME', 8), ('call', 'fee', 3, 'DOUBLE', 8)) AS v(table_name, column_name, position, data_type, width)""")
def ddl_columns(t, spark, sf):
    session = Session(spark)
    session.script(_CRUISE)
    return session.run("SELECT table_name, column_name, position, data_type, width FROM sys_columns")


@query("""SELECT * FROM (VALUES ('call', 'CREATE INDEX call_port USING EHASH ON call (port_id)'), ('port', 'CREATE UNIQUE INDEX port_name USING BTREE ON port (name(10), id DESC)')) AS v(table_name, statement)""")
def ddl_indexes(t, spark, sf):
    session = Session(spark)
    session.script(_CRUISE)
    rows = [(m.name, i.ddl(m.name)) for m in session.catalog.tables.values() for i in m.indexes]
    return spark.createDataFrame(rows, "table_name string, statement string")


@query("""SELECT CAST(port_id AS INTEGER) AS port_id, called, logged, CAST(fee AS DOUBLE) AS fee FROM (
    SELECT 1 AS port_id, '12:08:15' AS called, '2015-05-30 09:06:36' AS logged, 5.5 AS fee UNION ALL SELECT 2, '09:14:12', '2016-06-22 09:15:45', 0.0 UNION ALL SELECT 3, NULL, NULL, NULL
    UNION ALL SELECT n_nationkey + 100, NULL, NULL, 1.0 FROM nation WHERE n_regionkey = 1)""")
def sql_data_changes(t, spark, sf):
    """Typed literals, ROW, columns that are left out, OVERRIDING, rows from a query, and a sequence of changes."""
    session = Session(spark, {"nation": t("nation")})
    session.script(_CRUISE)
    session.script("""
        INSERT INTO port VALUES (1, 'Arrecife', DATE '1976-06-22'), (2, 'Bari', DATE '1977-07-21');
        INSERT INTO call VALUES (1, TIME '12:08:15', TIMESTAMP '2015-05-30 09:06:36', 5.5);
        INSERT INTO call VALUES ROW (2, TIME '12:08:15', TIMESTAMP '2015-05-30 09:06:36', 9.5), ROW (9, TIME '23:00:00', NULL, 2.0);
        INSERT INTO call (port_id) VALUES (3);
        INSERT INTO call (port_id, fee) OVERRIDING USER VALUE SELECT n_nationkey + 100, 1.0 FROM nation WHERE n_regionkey = 1;
        UPDATE call SET at = TIME '09:14:12', logged = TIMESTAMP '2016-06-22 09:15:45', fee = 0 WHERE port_id IN (SELECT id FROM port WHERE opened > DATE '1977-01-01');
        DELETE FROM call WHERE port_id > 5 AND at = TIME '23:00:00'""")
    return session.run("SELECT port_id, at AS called, date_format(logged, 'yyyy-MM-dd HH:mm:ss') AS logged, fee FROM call")


@query("SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 1000 AND 5000")
def sql_between_symmetric(t, spark, sf):
    return Session(spark, {"supplier": t("supplier")}).run("SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal BETWEEN SYMMETRIC 5000 AND 1000")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(s_suppkey) AS INTEGER) AS last FROM supplier")
def sql_group_by_nothing(t, spark, sf):
    return Session(spark, {"supplier": t("supplier")}).run("SELECT count(*) AS n, CAST(max(s_suppkey) AS INT) AS last FROM supplier GROUP BY ()")


@query("SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier AS s, nation AS n, region AS r WHERE s.s_nationkey = n.n_nationkey AND r.r_regionkey > 2")
def sql_disconnected_join(t, spark, sf):
    """A comma list of which one table has no condition with the others."""
    session = Session(spark, {n: t(n) for n in ("supplier", "nation", "region")})
    return session.run("SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier AS s, nation AS n, region AS r WHERE s.s_nationkey = n.n_nationkey AND r.r_regionkey > 2")
