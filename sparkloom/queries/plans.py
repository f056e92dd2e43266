"""The query language, its rewrites, the catalog and the estimator."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog import Catalog, IndexMeta
from sparkloom.plans.estimate import explain
from sparkloom.plans.lower import lower
from sparkloom.plans.optimize import narrowed, optimized
from sparkloom.plans.qexpr import parse
from sparkloom.plans.rewrite import push_aggregation
from sparkloom.plans.sql import Session
from sparkloom.queries.base import query
from sparkloom.sources.tables import catalog

FLAGSHIP = """(DISTINCT,(PROJECT(<c.c_name, l.l_returnflag>),(SELECT,(EQJOIN(o.o_orderkey,l.l_orderkey),
    (EQJOIN(c.c_custkey,o.o_custkey),GET(customer,c),GET(orders,o)),GET(lineitem,l)),
    (OP_OR,(OP_GT,ATTR(c.c_acctbal),FLOAT(9000.0)),(OP_LT,ATTR(c.c_acctbal),FLOAT(0.0))))))"""


@query("SELECT DISTINCT c.c_name, l.l_returnflag FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_acctbal > 9000.0 OR c.c_acctbal < 0.0")
def flagship_distinct_join(t, spark, sf):
    return lower(parse(FLAGSHIP), t)


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def qexpr_select(t, spark, sf):
    return lower(parse('(PROJECT(<n_name>),(SELECT,GET("nation"),(OP_EQ,ATTR("n_regionkey"),INT(1))))'), t)


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_custkey")
def qexpr_aggregate(t, spark, sf):
    return lower(parse("(AGG_LIST(<o_orderkey AS keys>),GROUP_BY(<o_custkey>),GET(orders))"), t)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 100")
def qexpr_order(t, spark, sf):
    return lower(parse("(ORDER_BY(<s_acctbal DESC, s_suppkey>),(PROJECT(<s_suppkey, s_acctbal>),(SELECT,GET(supplier),(OP_GEQ,ATTR(s_acctbal),INT(100)))))"), t)


@query("SELECT c_custkey FROM customer WHERE (c_name LIKE '%7%' AND NOT c_nationkey IN (1, 2, 3)) OR c_acctbal <> c_acctbal")
def qexpr_predicates(t, spark, sf):
    text = '(PROJECT(<c_custkey>),(SELECT,GET(customer),(OP_OR,(OP_AND,(OP_LIKE,ATTR(c_name),STR("%7%")),(OP_NOT,(OP_IN,ATTR(c_nationkey),INT(1),INT(2),INT(3)))),(OP_NE,ATTR(c_acctbal),ATTR(c_acctbal)))))'
    return lower(parse(text), t)


@query("SELECT r.r_name, s.s_name FROM region r CROSS JOIN supplier s")
def qexpr_cross(t, spark, sf):
    return lower(parse("(PROJECT(<r.r_name, s.s_name>),(EQJOIN(),GET(region,r),GET(supplier,s)))"), t)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1998-01-01'")
def qexpr_date(t, spark, sf):
    return lower(parse("(PROJECT(<o_orderkey>),(SELECT,GET(orders),(OP_GT,ATTR(o_orderdate),DATE(1998-01-01))))"), t)


REVENUE = """// Revenue by order: an aggregate of two columns, in the older form of the language.
(ORDER_BY (.charge, o.o_orderkey),
   (PROJECT (o.o_orderkey, .charge),
      (AGG_LIST ( (<l.l_linenumber, l.l_quantity> AS charge), (GROUP_BY <o.o_orderkey>) ),  /* sums of both */
         (EQJOIN(l.l_orderkey, o.o_orderkey),
            GET("lineitem", l),
            (SELECT, GET("orders", o), (OP_GT, ATTR("o.o_custkey"), INT("20"))) ) ) ) )"""


@query("SELECT o_orderkey, CAST(sum(CAST(l_linenumber + l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS charge FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey > 20 GROUP BY o_orderkey")
def qexpr_older_form(t, spark, sf):
    return lower(parse(REVENUE), t)


_PUSHED = "(AGG_LIST(<l.l_linenumber AS lines>),GROUP_BY(<l.l_orderkey>),(EQJOIN(o.o_orderkey,l.l_orderkey),GET(orders,o),GET(lineitem,l)))"


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def rewrite_agg_pushdown(t, spark, sf):
    return lower(push_aggregation(parse(_PUSHED), catalog(spark, sf, "orders", "lineitem")), t).select("l_orderkey", "lines")


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def rewrite_agg_off(t, spark, sf):
    """The same query without the rewrite, for comparison in the bench."""
    return lower(parse(_PUSHED), t)


_SEARCHED = """(PROJECT(<l.l_orderkey, l.l_linenumber, n.n_name>),(EQJOIN(c.c_nationkey,n.n_nationkey),
    (EQJOIN(o.o_custkey,c.c_custkey),(EQJOIN(l.l_orderkey,o.o_orderkey),GET(lineitem,l),GET(orders,o)),GET(customer,c)),
    (SELECT,GET(nation,n),(OP_LT,ATTR(n.n_nationkey),INT(3)))))"""


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3")
def optimized_join_order(t, spark, sf):
    """Four tables, joined in the order and the ways that the estimates favour."""
    return lower(optimized(parse(_SEARCHED), catalog(spark, sf, "lineitem", "orders", "customer", "nation")), t)


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3")
def written_join_order(t, spark, sf):
    """The same query in the order as written, for comparison in the bench."""
    return lower(parse(_SEARCHED), t)


@query("SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0")
def rewrite_semi_join(t, spark, sf):
    """A keyed right side that only selects rows: no column of it is read above."""
    node = parse("(PROJECT(<o.o_orderkey>),(EQJOIN(o.o_custkey,c.c_custkey),GET(orders,o),(SELECT,GET(customer,c),(OP_GT,ATTR(c.c_acctbal),INT(0)))))")
    return lower(narrowed(node, set(), catalog(spark, sf, "orders", "customer")), t)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST((SELECT count(*) FROM {n}) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS INTEGER) AS n_columns, 'HEAP' AS data_order" for n in _TABLES) + ")")
def sys_tables(t, spark, sf):
    return catalog(spark, sf).sys_tables(spark)


_KIND = "CASE data_type WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'DATETIME' ELSE data_type END"


@query(f"""SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position, {_KIND} AS data_type,
    CASE {_KIND} WHEN 'BIGINT' THEN 8 WHEN 'DOUBLE' THEN 8 WHEN 'DATETIME' THEN 8 WHEN 'INT' THEN 4 WHEN 'DATE' THEN 3 ELSE 32 END AS width
    FROM information_schema.columns WHERE table_name IN {_TABLES}""")
def sys_columns(t, spark, sf):
    return catalog(spark, sf).sys_columns(spark).drop("n_distinct")


@query("""SELECT * FROM (VALUES ('region', 'PRIMARY_KEY', 'r_regionkey', NULL, NULL), ('nation', 'PRIMARY_KEY', 'n_nationkey', NULL, NULL), ('customer', 'PRIMARY_KEY', 'c_custkey', NULL, NULL),
    ('supplier', 'PRIMARY_KEY', 's_suppkey', NULL, NULL), ('part', 'PRIMARY_KEY', 'p_partkey', NULL, NULL), ('orders', 'PRIMARY_KEY', 'o_orderkey', NULL, NULL), ('events', 'PRIMARY_KEY', 'event_id', NULL, NULL),
    ('nation', 'FOREIGN_KEY', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'FOREIGN_KEY', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 'FOREIGN_KEY', 's_nationkey', 'nation', 'n_nationkey'),
    ('orders', 'FOREIGN_KEY', 'o_custkey', 'customer', 'c_custkey'), ('lineitem', 'FOREIGN_KEY', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'FOREIGN_KEY', 'l_partkey', 'part', 'p_partkey'),
    ('lineitem', 'FOREIGN_KEY', 'l_suppkey', 'supplier', 's_suppkey')) AS v(table_name, kind, columns, ref_table, ref_columns)""")
def sys_constraints(t, spark, sf):
    return catalog(spark, sf).sys_constraints(spark)


@query("""SELECT * FROM (VALUES ('customer', 'customer_pk', 'BTREE', 'c_custkey', true, true), ('orders', 'orders_customer', 'LHASH', 'o_custkey', false, false)) AS v(table_name, index_name, kind, columns, clustered, is_unique)""")
def sys_indexes(t, spark, sf):
    found = catalog(spark, sf, "customer", "orders")
    found.create_index("customer", IndexMeta("customer_pk", "BTREE", ("c_custkey",), clustered=True, unique=True), t("customer"))
    found.create_index("orders", IndexMeta("orders_customer", "LHASH", ("o_custkey",)))
    return found.sys_indexes(spark)


BOATING = """<systemCatalog pageSize="4096"><tables>
  <table name="skipper"><cardinality>2000</cardinality><width>64</width><columns>
    <column name="id" type="integer"><width>4</width><distinctValues>2000</distinctValues><minimum>1</minimum><maximum>2000</maximum></column>
    <column name="grade" type="integer"><width>4</width><distinctValues>5</distinctValues><minimum>1</minimum><maximum>5</maximum></column>
    <column name="title" type="character varying(56)"><width>56</width><distinctValues>1800</distinctValues></column></columns>
    <primaryKey><columns><column ref="id"/></columns></primaryKey>
    <indexes><index name="by_id" type="btree" clustered="true"><keyColumns><column ref="id"/></keyColumns></index></indexes></table>
  <table name="trip"><cardinality>10000</cardinality><width>16</width><columns>
    <column name="skipper_id" type="integer"><width>4</width><distinctValues>2000</distinctValues></column>
    <column name="day" type="date"><width>12</width><distinctValues>365</distinctValues></column></columns>
    <foreignKey><sourceColumns><column ref="skipper_id"/></sourceColumns><targetColumns><column ref="id" table="skipper"/></targetColumns></foreignKey></table>
</tables></systemCatalog>"""
_TRIPS = "(DISTINCT,(PROJECT(<s.title>),(EQJOIN(t.skipper_id,s.id),GET(trip,t),(SELECT,GET(skipper,s),(OP_GT,ATTR(s.grade),INT(3))))))"


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# By hand: a skipper fills 64 of 4096 bytes, 2000 are 32 pages; a trip 16, 10000 are 40 pages. Half of the grades
# are over 3, so 1000 skippers in 16 pages. The join keeps the referencing side, 10000 rows. Of 1800 titles 948 are
# left in half of the rows, and half of these are taken for the join.
@query("""SELECT node, depth, operator, CAST(cardinality AS DOUBLE) AS cardinality, CAST(unique_cardinality AS DOUBLE) AS unique_cardinality, CAST(row_bytes AS DOUBLE) AS row_bytes, CAST(io AS DOUBLE) AS io, CAST(cpu AS DOUBLE) AS cpu FROM (VALUES
    (0, 0, 'DISTINCT', 474, 474, 16.0, 3.42, 0.7593), (1, 1, 'PROJECT', 10000, 474, 16.0, 3.42, 0.55456), (2, 2, 'HASH_JOIN', 10000, 10000, 80.0, 3.42, 0.45456),
    (3, 3, 'SCAN', 10000, 10000, 16.0, 1.2, 0.0012), (4, 3, 'FILTER', 1000, 1000, 64.0, 0.96, 0.03096), (5, 4, 'SCAN', 2000, 2000, 64.0, 0.96, 0.00096)
    ) AS v(node, depth, operator, cardinality, unique_cardinality, row_bytes, io, cpu)""")
def explain_catalog_file(t, spark, sf):
    return _rounded(explain(spark, parse(_TRIPS), Catalog.from_xml(BOATING)).drop("cost"))


@query("""SELECT node, depth, operator, CAST(cardinality AS DOUBLE) AS cardinality, CAST(row_bytes AS DOUBLE) AS row_bytes FROM (VALUES (0, 0, 'FILTER', 50000, 52.0), (1, 1, 'SCAN', 100000, 52.0)) AS v(node, depth, operator, cardinality, row_bytes)""")
def explain_with_stats(t, spark, sf):
    """A plan estimated after statistics were changed by UPDATE on the catalog's own tables."""
    session = Session(spark, {}, catalog(spark, sf, "supplier"))
    session.script("UPDATE sys_tables SET n_rows = 100000 WHERE table_name = 'supplier'; UPDATE sys_columns SET n_distinct = 2 WHERE column_name = 's_nationkey'")
    return explain(spark, parse("(SELECT,GET(supplier),(OP_EQ,ATTR(s_nationkey),INT(1)))"), session.catalog).select("node", "depth", "operator", "cardinality", "row_bytes")
