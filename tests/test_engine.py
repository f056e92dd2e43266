"""Types, catalog, query language, estimator, rewrites and access paths."""

import json
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.catalog import Catalog, ColumnMeta, ForeignKey, IndexMeta, TableMeta
from sparkloom.functions import dates
from sparkloom.functions.hashing import tuple_hash
from sparkloom.operators import access, hashed, joins
from sparkloom.plans import algebra as A
from sparkloom.plans.estimate import CPU_READ, IO, Estimator, explain, explain_text
from sparkloom.plans.lower import lower
from sparkloom.plans.optimize import narrowed, optimized
from sparkloom.plans.qexpr import QuerySyntaxError, parse, unparse
from sparkloom.plans.rewrite import keys_of, push_aggregation, semi_joined
from sparkloom.plans.sql import Session, standard
from sparkloom.sources.tables import Files, bulk_load, catalog, table
from sparkloom.types import DataType as D
from sparkloom.types import aggregate_type, common_type, comparable


def test_widening():
    assert common_type(D.TINYINT, D.INT) is D.INT
    assert common_type(D.INT, D.FLOAT) is D.FLOAT
    assert common_type(D.BIGINT, D.FLOAT) is D.DOUBLE
    assert common_type(D.SMALLINT, D.DOUBLE) is D.DOUBLE
    assert common_type(D.DATE, D.DATETIME) is None
    assert common_type(D.CHAR, D.VARCHAR) is None
    assert common_type(D.TINYINT, D.SMALLINT, D.FLOAT) is D.FLOAT
    assert comparable(D.DATE, D.DATETIME) and comparable(D.CHAR, D.VARCHAR) and not comparable(D.TIME, D.DATE)
    assert aggregate_type("count", D.DATE) is D.BIGINT and aggregate_type("SUM", D.INT) is D.INT
    assert D.parse("character varying(25)") is D.VARCHAR and D.parse("int") is D.INT


def sailing() -> Catalog:
    c = Catalog()
    c.create_table(TableMeta("S", (ColumnMeta("sid", D.INT, 0, 750, 0, 749), ColumnMeta("sname", D.VARCHAR, 25, 675), ColumnMeta("rating", D.INT, 0, 6, 0, 5)), 750, (("sid",),)))
    c.create_table(TableMeta("B", (ColumnMeta("bid", D.INT, 0, 250, 0, 249), ColumnMeta("color", D.VARCHAR, 10, 10)), 250, (("bid",),)))
    c.create_table(TableMeta("R", (ColumnMeta("rsid", D.INT, 0, 750), ColumnMeta("rbid", D.INT, 0, 250)), 1500, (), (ForeignKey(("rsid",), "S", ("sid",)), ForeignKey(("rbid",), "B", ("bid",)))))
    return c


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("(SELECT,GET(S),(OP_GT,ATTR(rating),INT(3)))", 300),
        ("(SELECT,GET(S),(OP_LT,INT(3),ATTR(rating)))", 300),
        ("(SELECT,GET(S),(OP_LT,ATTR(rating),INT(5)))", 750),
        ("(SELECT,GET(S),(OP_OR,(OP_GT,ATTR(rating),INT(3)),(OP_LT,ATTR(rating),INT(5))))", 750),
        ("(SELECT,GET(S),(OP_EQ,ATTR(sid),INT(7)))", 1),
        ('(SELECT,GET(S),(OP_LIKE,ATTR(sname),STR("a%")))', 38),
        ("(SELECT,GET(S),(OP_IN,ATTR(rating),INT(1),INT(2)))", 250),
        ("(SELECT,GET(S),SEL(0.5,(OP_EQ,ATTR(sid),INT(7))))", 375),
        ("(EQJOIN(rsid,sid),GET(R),GET(S))", 1500),
        ("(EQJOIN(bid,rbid),GET(B),GET(R))", 1500),
        ("(EQJOIN(),GET(S),GET(B))", 187500),
        ("(EQJOIN(bid,sid),GET(B),GET(S))", 18750),
        ("(DISTINCT,(PROJECT(<rating>),GET(S)))", 6),
        ("(AGG_LIST(<COUNT * AS n>),GROUP_BY(<rating>),GET(S))", 6),
        ("(AGG_LIST(<COUNT * AS n>),GET(S))", 1),
    ],
)
def test_cardinality(text, rows):
    assert Estimator(sailing()).estimate(parse(text)).cardinality == pytest.approx(rows)


def test_cost_and_explain(spark):
    c = sailing()
    e = Estimator(c).estimate(parse("(SELECT,GET(S),(OP_EQ,ATTR(sid),INT(7)))"))
    assert e.operator == "FILTER" and e.cost > e.inputs[0].cost > 0
    c.create_index("S", IndexMeta("pk", "BTREE", ("sid",), clustered=True))
    indexed = Estimator(c).estimate(parse("(SELECT,GET(S),(OP_EQ,ATTR(sid),INT(7)))"))
    assert indexed.operator.startswith("INDEX_FILTER") and indexed.cost < e.cost
    c.with_statistics("S", 7500)
    assert explain(spark, parse("(DISTINCT,GET(S))"), c).count() == 2
    assert explain_text(parse("(DISTINCT,GET(S))"), c).startswith("DISTINCT (cost ")


def test_costs_by_hand():
    """Rows of 100 bytes, 40 on a page of 4096: 1000 rows are 25 pages, 50 rows 2."""
    c = Catalog()
    columns = lambda p: (ColumnMeta(f"{p}k", D.INT, 0, 1000, 0, 999), ColumnMeta(f"{p}t", D.CHAR, 96, 10))
    c.create_table(TableMeta("A", columns("a"), 1000, (("ak",),)))
    c.create_table(TableMeta("B", columns("b"), 50, (("bk",),), (ForeignKey(("bk",), "A", ("ak",)),)))
    e = Estimator(c)
    scan = e.estimate(parse("GET(A)"))
    assert (scan.io, scan.cpu) == (25 * IO, 25 * CPU_READ)
    join = parse("(EQJOIN(bk,ak),GET(B),GET(A))")
    ways = e._ways(join, e.estimate(parse("GET(B)")), scan, 50)
    assert ways["HASH"][:2] == pytest.approx((3 * 27 * 0.0075, 1050 * 2e-5 + 25 * 40 * 1e-5 + 50 * 1e-5))
    assert ways["NESTED_LOOPS"][:2] == pytest.approx((50 * 25 * (0.03 + 3e-5), 50 * 1000 * 1e-5 + 50 * 1e-5))
    assert ways["MERGE"][:2] == pytest.approx((0, 1050 * 1e-5 + 50 * 1e-5))
    assert sum(i.cpu for i in ways["MERGE"][2]) == pytest.approx(2 * (50 * 5.643856 + 1000 * 9.965784) * 3e-5)
    c.create_index("A", IndexMeta("ix", "LHASH", ("ak",)))
    c.create_index("A", IndexMeta("bits", "BITMAP_JOIN", ("ak",)))
    ways = Estimator(c)._ways(join, e.estimate(parse("GET(B)")), scan, 50)
    assert ways["INDEX_NESTED_LOOPS"][:2] == pytest.approx(((1 + 2) * 0.03, 50 * 1e-5 + 50 * (6e-5 + 1e-5)))
    assert "BITMAP" not in ways  # the right side is not selected
    chosen = parse('(EQJOIN(bk,ak),GET(B),(SELECT,GET(A),(OP_EQ,ATTR(at),STR("x"))))')
    right = e.estimate(chosen.right)
    assert Estimator(c)._ways(chosen, e.estimate(parse("GET(B)")), right, 50)["BITMAP"][:2] == pytest.approx((50 / 10_000 * 0.03, 50 * 4e-5 + 50 * 1e-5))
    # An unclustered index reads no block twice: all 25 pages at most, and one of entries.
    c.create_index("A", IndexMeta("tree", "BTREE", ("at",)))
    wide = Estimator(c).estimate(parse('(SELECT,GET(A),(OP_GT,ATTR(at),STR("x")))'))
    assert wide.operator == "FILTER"  # half of the rows: 26 pages by the index, 25 by a scan
    few = Estimator(c)._index_cost(c.tables["A"].indexes[-1], scan, 10)
    assert few == pytest.approx((11 * 0.03, 11 * 3e-5))


def chain(spark, sf):
    return catalog(spark, sf, "lineitem", "orders", "customer", "nation", "region")


WRITTEN = "(EQJOIN(n.n_regionkey,r.r_regionkey),(EQJOIN(c.c_nationkey,n.n_nationkey),(EQJOIN(o.o_custkey,c.c_custkey),GET(orders,o),GET(customer,c)),GET(nation,n)),(SELECT,GET(region,r),(OP_EQ,ATTR(r.r_regionkey),INT(1))))"


def test_join_order(spark, sf):
    c = chain(spark, sf)
    node = parse(WRITTEN)
    best, price = optimized(node, c), Estimator(c)
    tree = best.child if isinstance(best, A.Project) else best
    assert isinstance(tree, A.EquiJoin) and tree.left_keys != node.left_keys and price.estimate(tree).cost < price.estimate(node).cost
    t = lambda n: table(spark, sf, n)
    a, b = lower(node, t), lower(best, t)
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect()) and a.count()

    def joins(n):
        return [] if isinstance(n, A.Get) else [n for n in [n] if isinstance(n, A.EquiJoin)] + [j for k in A.children(n) for j in joins(k)]

    assert len(joins(best)) == 3 and all(j.strategy and j.left_keys for j in joins(best))
    # A product is made only where the query has one, and inside other nodes.
    product = parse("(DISTINCT,(PROJECT(<n.n_name>),(EQJOIN(),GET(nation,n),GET(region,r))))")
    assert optimized(product, c) == product
    # Every order of three tables in a row that is connected is among those searched: the cheapest is not dearer than any.
    three = [("(EQJOIN(c.c_custkey,o.o_custkey),GET(customer,c),GET(orders,o))", "c.c_nationkey"), ("(EQJOIN(o.o_custkey,c.c_custkey),GET(orders,o),GET(customer,c))", "c.c_nationkey")]
    trees = [f"(EQJOIN({k},n.n_nationkey),{x},GET(nation,n))" for x, k in three] + [f"(EQJOIN(n.n_nationkey,{k}),GET(nation,n),{x})" for x, k in three]
    best = optimized(parse(trees[0]), c)
    assert price.estimate(best.child if isinstance(best, A.Project) else best).cost <= min(price.estimate(parse(x)).cost for x in trees) + 1e-9


def test_pushed_aggregation_is_part_of_the_search(spark, sf):
    c = chain(spark, sf)
    node = parse("(AGG_LIST(<l.l_linenumber AS lines>),GROUP_BY(<l.l_orderkey>),(EQJOIN(o.o_orderkey,l.l_orderkey),GET(orders,o),GET(lineitem,l)))")
    t = lambda n: table(spark, sf, n)
    got = lower(optimized(node, c), t)
    assert got.columns == ["l_orderkey", "lines"] and sorted(got.collect()) == sorted(lower(node, t).collect())


def test_semi_join_only_without_right_columns(spark, sf):
    c = chain(spark, sf)
    join = "(EQJOIN(o.o_custkey,c.c_custkey),GET(orders,o),(SELECT,GET(customer,c),(OP_GT,ATTR(c.c_acctbal),INT(0))))"
    t = lambda n: table(spark, sf, n)
    for columns, strategy in (("o.o_orderkey", "semi"), ("o.o_orderkey, c.c_name", None)):
        node = parse(f"(PROJECT(<{columns}>),{join})")
        found = narrowed(node, set(), c)
        assert found.child.strategy == strategy
        assert sorted(lower(found, t).collect()) == sorted(lower(node, t).collect())


def test_statistics_are_stored(spark, sf, monkeypatch):
    first = catalog(spark, sf, "supplier")
    monkeypatch.setattr(Catalog, "describe", lambda *a, **k: pytest.fail("scanned again"))
    again = catalog(spark, sf, "supplier")
    assert again.tables == first.tables and again.tables["supplier"].cardinality == table(spark, sf, "supplier").count()


def test_strategies_keep_to_sizes(spark, monkeypatch):
    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(40).withColumnRenamed("id", "y")
    plan = lambda s: joins.equi_join(a, b, [("x", "y")], s)._jdf.queryExecution().sparkPlan().toString()
    names = {"broadcast": "BroadcastHashJoin", "hash": "ShuffledHashJoin", "nested_loops": "CartesianProduct", "merge": "SortMergeJoin"}
    assert all(n in plan(s) for s, n in names.items())
    monkeypatch.setattr(joins, "size_of", lambda df: 1 << 50)
    assert all("SortMergeJoin" in plan(s) for s in names)


def test_catalog(spark, sf):
    c = sailing()
    with pytest.raises(ValueError):
        c.create_table(c.tables["S"])
    c.create_index("S", IndexMeta("i", "LHASH", ("sname",)))
    with pytest.raises(ValueError):
        c.create_index("B", IndexMeta("i", "BTREE", ("bid",)))
    assert c.sys_indexes(spark).count() == 1
    c.drop_index("i")
    assert c.sys_indexes(spark).count() == 0
    assert c.tables["R"].ddl().startswith("CREATE TABLE R (rsid INT, rbid INT, FOREIGN KEY (rsid) REFERENCES S (sid)")
    with pytest.raises(ValueError, match="is no key"):
        Catalog().describe("lineitem", table(spark, sf, "lineitem"), (("l_orderkey", "l_linenumber"),))


XML = """<?xml version="1.0" encoding="UTF-8"?>
<!-- two tables -->
<systemCatalog name="x" pageSize="2048" xmlns="http://example.org/catalog">
  <tables>
    <table name="T"><cardinality>500</cardinality><pages>9</pages><width>24</width>
      <columns>
        <column name="a" type="integer"><width>4</width><distinctValues>500</distinctValues><minimum>1</minimum><maximum>900</maximum></column>
        <column name="b" type="character varying(12)"><width>12</width></column>
        <column name="c" type="numeric(15,2)"><width>8</width><minimum>2001-01-01</minimum></column>
      </columns>
      <primaryKey><columns><column ref="a"/></columns></primaryKey>
      <indexes><index name="ix" type="btree" clustered="true"><pages>3</pages><cardinality>500</cardinality><keyColumns><column ref="a"/></keyColumns></index>
        <index name="ib" type="shash"><keyColumns><column ref="b"/><column ref="c"/></keyColumns></index></indexes>
    </table>
    <table name="U"><cardinality>7</cardinality><columns><column name="d" type="date"><width>8</width></column><column name="t" type="integer"/></columns>
      <foreignKey><sourceColumns><column ref="t"/></sourceColumns><targetColumns><column ref="a" table="T"/></targetColumns></foreignKey></table>
  </tables>
</systemCatalog>"""


def test_catalog_file():
    c = Catalog.from_xml(XML)
    t, u = c.tables["T"], c.tables["U"]
    assert (t.cardinality, t.row_bytes, t.page_bytes, t.blocks, t.keys) == (500, 24, 2048, 6, (("a",),))
    assert (t.column("a").distinct, t.column("a").low, t.column("a").high) == (500, 1, 900)
    assert (t.column("b").kind, t.column("b").width, t.column("b").distinct, t.column("c").kind, t.column("c").low) == (D.VARCHAR, 12, None, D.DOUBLE, None)
    assert [(i.name, i.kind, i.columns, i.clustered) for i in t.indexes] == [("ix", "BTREE", ("a",), True), ("ib", "SHASH", ("b", "c"), False)]
    assert u.foreign == (ForeignKey(("t",), "T", ("a",)),) and u.row_bytes == 12
    assert Catalog.from_plain(json.loads(json.dumps(c.to_plain()))).tables == c.tables
    for broken in ("<catalog/>", XML.replace('ref="t"', 'ref="zz"'), XML.replace('table="T"', 'table="V"'), XML.replace('name="U"', 'name="T"')):
        with pytest.raises(ValueError):
            Catalog.from_xml(broken)


def test_unique_index(spark):
    c, df = sailing(), spark.createDataFrame([(1, "abc"), (2, "abd"), (3, None), (4, None)], "sid int, sname string")
    c.create_index("S", IndexMeta("u", "BTREE", ("sname",), unique=True), df)
    with pytest.raises(ValueError, match="repeat"):
        c.create_index("S", IndexMeta("p", "BTREE", ("sname",), unique=True, prefix=(2,)), df)
    with pytest.raises(ValueError, match="no column"):
        c.create_index("S", IndexMeta("q", "BTREE", ("zz",)))


def test_statements(spark):
    session = Session(spark)
    session.script("CREATE TABLE t (a INTEGER PRIMARY KEY, b VARCHAR(9), UNIQUE (b)); INSERT INTO t VALUES (1, 'x;y'), (2, NULL); -- a comment; with a sign\nINSERT INTO t (a) VALUES (3)")
    assert sorted(map(tuple, session.tables["t"].collect()), key=lambda r: r[0]) == [(1, "x;y"), (2, None), (3, None)]
    for wrong in ("INSERT INTO t VALUES (1, 'z')", "INSERT INTO t VALUES (7, 'q'), (7, 'r')", "INSERT INTO t VALUES (8, 'x;y')", "UPDATE t SET a = 5", "INSERT INTO t (a) VALUES (1, 2)", "UPDATE t SET zz = 1", "DROP TABLE none", "DROP INDEX none", "MERGE t", "UPDATE sys_tables SET n_columns = 3"):
        with pytest.raises(ValueError):
            session.run(wrong)
    for k in range(20):  # more changes than are kept in a plan
        session.run(f"UPDATE t SET b = 'v{k}' WHERE a = 2")
    session.run("DELETE FROM t WHERE b LIKE 'x%'")
    assert sorted(map(tuple, session.run("SELECT * FROM t").collect()), key=lambda r: r[0]) == [(2, "v19"), (3, None)]
    session.run("DELETE FROM t")
    assert session.tables["t"].count() == 0
    with pytest.raises(ValueError, match="referred to"):
        session.script("CREATE TABLE u (x INTEGER REFERENCES t (a)); DROP TABLE t")
    session.script("DROP TABLE u; DROP TABLE t")
    assert not session.tables and not session.catalog.tables


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT a FROM t WHERE a BETWEEN SYMMETRIC 5 AND 3", "SELECT a FROM t WHERE a BETWEEN least(5, 3) AND greatest(5, 3)"),
        ("SELECT a FROM t WHERE b between symmetric 'z' and (1 + 2)", "SELECT a FROM t WHERE b BETWEEN least('z', (1 + 2)) AND greatest('z', (1 + 2))"),
        ("SELECT a FROM t HAVING a > 3", "SELECT a FROM t WHERE a > 3"),
        ("SELECT a FROM t WHERE b = 1 HAVING a > 3", "SELECT a FROM t WHERE b = 1 AND a > 3"),
        ("SELECT a, count(*) FROM t GROUP BY a HAVING a > 3", "SELECT a, count(*) FROM t GROUP BY a HAVING a > 3"),
        ("SELECT count(*) FROM t HAVING count(*) > 3", "SELECT count(*) FROM t HAVING count(*) > 3"),
        ("SELECT count(*) FROM t GROUP BY ( )", "SELECT count(*) FROM t "),
        ("SELECT a FROM t WHERE a > TIME '12:00:00' AND b = TIMESTAMP '2001-01-01 00:00:00'", "SELECT a FROM t WHERE a > '12:00:00' AND b = TIMESTAMP '2001-01-01 00:00:00'"),
    ],
)
def test_standard_forms(text, want):
    assert standard(text) == want


@pytest.mark.parametrize("kind", hashed.KINDS)
def test_hash_files(spark, tmp_path, kind):
    """All rows are there, keys with very many rows and null keys too; each lookup finds its rows."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id AS v", "CAST(id % 5 AS STRING) AS s")
    f = hashed.store(df, str(tmp_path / kind), ["k", "s"], kind, buckets=8, capacity=100)
    assert hashed.HashFile.open(spark, str(tmp_path / kind)) == f
    assert f.scan(spark).exceptAll(df).isEmpty() and f.scan(spark).count() == 3000
    for k, s in ((7, "0"), (11, "1"), (11, "2"), (2999, "4")):
        assert f.lookup(spark, k, s).count() == df.where((F.col("k") == k) & (F.col("s") == s)).count()
    sizes = [r["count"] for r in spark.read.parquet(f.path).groupBy("bucket__").count().collect()]
    assert len(sizes) <= f.buckets and (kind == "static" or f.buckets > 8)


def test_extendible_directory(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    directory = hashed._directory(df, ["k"], 400)
    held = {}
    for r in df.select(F.pmod(tuple_hash(F.col("k")), F.lit(len(directory))).cast("int").alias("at")).groupBy("at").count().collect():
        held[directory[r["at"]]] = held.get(directory[r["at"]], 0) + r["count"]
    assert max(held.values()) <= 400 and sum(held.values()) == 5000 and set(directory) == set(range(max(directory) + 1))


def test_tuple_hash(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, CAST(NULL AS STRING)), (CAST(NULL AS INT), 'a'), (NULL, NULL), (1, 'a') AS t(x, y)")
    assert df.select(tuple_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4


def test_files(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    rows = spark.range(3)
    assert files.create("t", rows).count() == 3
    with pytest.raises(AnalysisException):
        files.create("t", rows)
    temp = files.temp(rows)
    assert temp.count() == 3
    files.drop("t")
    with pytest.raises(ValueError, match="no table"):
        files.drop("t")
    files.close()
    assert not files.temporary


def test_older_form():
    text = """/* block
       comment */ (ORDER_BY (.REV, o.d), // rest of a line
       (PROJECT (l.k, .REV, o.d), (AGG_LIST ( (<l.a, l.b> AS REV), (<l.c> AS C), (GROUP_BY <l.k, o.d>) ),
       (EQJOIN(l.k, o.k), (SELECT, GET("l"), (OP_GT, ATTR ("l.s"), INT("1998"))), (SELECT, GET("o"), (OP_EQ, ATTR("o.m"), INT("XXX")))))))"""
    node = parse(text)
    inner = node.child.child
    assert node.keys == (("REV", True), ("o.d", True)) and node.child.columns == ("l.k", "REV", "o.d")
    assert inner.aggregates == (A.Agg("SUM", ("l.a", "l.b"), "REV"), A.Agg("SUM", "l.c", "C")) and inner.groups == ("l.k", "o.d")
    assert inner.child.right.predicate.right == A.Const("XXX") and inner.child.left.predicate.right == A.Const(1998)
    assert parse(unparse(node)) == node
    hint = parse("(PROJECT,(EQJOIN(b.k, d.k),(SELECT,GET(b),SEL(0.055, b.k)),GET(d)))")
    assert hint.left.predicate.selectivity == 0.055
    assert parse('(SELECT,GET(S),(OP_EQ,ATTR(a),STR("// no comment")))').predicate.right.value == "// no comment"


NODES = [
    A.Distinct(A.Project(A.Select(A.EquiJoin(A.Get("R", "r"), A.Get("S", "s"), ("r.rsid",), ("s.sid",)), A.Logic("OR", (A.Compare("GT", A.Attr("rating"), A.Const(3)), A.Compare("LE", A.Attr("rating"), A.Const(-1.5))))), ("s.sname",))),
    A.OrderBy(A.Aggregate(A.Get("S"), ("rating",), (A.Agg("SUM", "sid", "total"), A.Agg("COUNT", None, "n"))), (("rating", False), ("total", True))),
    A.Select(A.EquiJoin(A.Get("S"), A.Get("B")), A.Logic("NOT", (A.Compare("IN", A.Attr("color"), A.Const(("red", "b, c"))),))),
    A.Select(A.Get("S"), A.Compare("NEQ", A.Attr("day"), A.Const(date(2001, 2, 3)), 0.25)),
]


@pytest.mark.parametrize("node", NODES)
def test_round_trip(node):
    assert parse(unparse(node)) == node


@given(st.text(alphabet='GET(),<>SELC "0.5x', max_size=30))
def test_parser_raises_only_syntax_errors(text):
    try:
        parse(text)
    except (QuerySyntaxError, ValueError, AttributeError):
        pass


def test_algebra_refuses():
    with pytest.raises(ValueError):
        A.Aggregate(A.Get("S"), ("rating",), ())
    with pytest.raises(ValueError):
        A.Agg("SUM", None, "x") and A.Aggregate(A.Get("S"), (), (A.Agg("SUM", None, "x"),))
    with pytest.raises(QuerySyntaxError):
        parse("(NOPE,GET(S))")


def test_rewrites(spark, sf):
    c = catalog(spark, sf, "orders", "lineitem", "customer")
    node = parse("(AGG_LIST(<l.l_linenumber AS lines>),GROUP_BY(<l.l_orderkey>),(EQJOIN(o.o_orderkey,l.l_orderkey),GET(orders,o),GET(lineitem,l)))")
    pushed = push_aggregation(node, c)
    assert isinstance(pushed, A.EquiJoin)
    t = lambda n: table(spark, sf, n)
    assert sorted(lower(node, t).collect()) == sorted(lower(pushed, t).select("l_orderkey", "lines").collect())
    # Not where the left side's join column is no key, nor where a group comes from the left.
    other = parse("(AGG_LIST(<l.l_linenumber AS n>),GROUP_BY(<l.l_orderkey>),(EQJOIN(o.o_custkey,l.l_orderkey),GET(orders,o),GET(lineitem,l)))")
    assert push_aggregation(other, c) is other
    left = parse("(AGG_LIST(<l.l_linenumber AS n>),GROUP_BY(<o.o_orderkey>),(EQJOIN(o.o_orderkey,l.l_orderkey),GET(orders,o),GET(lineitem,l)))")
    assert push_aggregation(left, c) is left
    join = parse("(EQJOIN(o.o_custkey,c.c_custkey),GET(orders,o),(SELECT,GET(customer,c),(OP_GT,ATTR(c.c_acctbal),INT(0))))")
    assert semi_joined(join, {"o.o_orderkey"}, c) and not semi_joined(join, {"c.c_name"}, c)
    assert frozenset({("o", "o_orderkey")}) in keys_of(join, c)


def test_access(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 7.0)], "k int, s string, v double")
    assert access.delete(df, F.col("v") > 6).count() == 2  # unknown stays
    assert access.update(df, F.col("v").isNull(), v=F.lit(0)).orderBy("k").first().v == 5.0
    assert [r.v for r in access.insert(df, spark.createDataFrame([(4,)], "k int")).orderBy("k").collect()] == [5.0, None, 7.0, None]
    assert access.ranked(spark.createDataFrame([], "a int, b int"), [("a", True)]).count() == 0
    assert bulk_load(df, str(tmp_path / "t")) == 3


def test_dates(spark):
    row = spark.sql("SELECT DATE '2000-02-29' AS d").select(dates.add_date(F.col("d"), 1, 1).alias("a"), dates.add_months(F.col("d"), 12).alias("b"), dates.add_weeks(F.col("d"), 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (date(2001, 3, 28), date(2001, 2, 28), date(2000, 3, 7))


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_ranked(spark, partitions):
    """Places of rows with nulls, texts, falling keys, and one value in nine of ten rows."""
    rows = [(None if k % 11 == 0 else "z" if k % 10 else f"t{k % 7}", None if k % 13 == 0 else k * 37 % 101, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "s string, n int, start int").repartition(4)
    for keys in ([("s", True), ("n", False), ("start", True)], [("s", False), ("n", True), ("start", False)], [("s", True)]):
        got = access.ranked(df, keys, partitions=partitions).orderBy("position").collect()
        assert got[0].__fields__ == ["s", "n", "start", "position"] and [r.position for r in got] == list(range(1, 1001))
        want = sorted(rows, key=lambda r: r[2])
        for name, up in reversed(keys):  # nulls first where a key rises, last where it falls
            at = ("s", "n", "start").index(name)
            want = sorted(want, key=lambda r: (r[at] is not None, r[at] if r[at] is not None else ""), reverse=not up)
        shown = [tuple(r)[: 3 if len(keys) > 1 else 1] for r in got]
        assert shown == [r[: 3 if len(keys) > 1 else 1] for r in want]
    assert access.ranked(df.limit(0), [("n", True)]).count() == 0


def test_frequent_value_is_many_partitions(spark):
    df = spark.range(20_000).selectExpr("1 AS a", "id AS b")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ranked = access.ranked(df, [("a", True)], partitions=8)
    assert ranked.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first() == (1, 20_000, 20_000)
    assert len([f for f in ranked.inputFiles() if "part-" in f]) == 8 and before == spark.conf.get("spark.sql.shuffle.partitions")
