"""Every relational query against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom import registry
from sparkloom.sources.tables import NAMES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or pd.isna(x):
            return "NULL"
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        return repr(float(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 72


def test_strategies_agree(spark, sf):
    q = registry.queries()
    want = sorted(q["join_equi"](spark, sf).collect())
    for name in ("join_hash", "join_sort_merge", "join_broadcast"):
        assert sorted(q[name](spark, sf).collect()) == want


def test_strategy_shows_in_plan(spark, sf):
    q = registry.queries()
    plan = lambda n: q[n](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan("join_sort_merge")
    assert "ShuffledHashJoin" in plan("join_hash")
    assert "BroadcastHashJoin" in plan("join_broadcast")
    assert "CartesianProduct" in plan("join_nl")
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in plan("lookup_by_key")


def test_pruned_buckets(spark, sf):
    """A lookup in a hash file reads one bucket."""
    q = registry.queries()
    for name in ("hash_static", "hash_extendible", "hash_linear"):
        found = q[name](spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket__" in plan, plan
        assert found.count() == 1


def test_without_optional_parts(tmp_path):
    """With the subpackage and its tests deleted, the entry module gives the other queries, and the other tests load and pass."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("sparkloom", "tests"):
        shutil.copytree(f"{root}/{folder}", tmp_path / folder, ignore=gone)
    for f in os.listdir(root):
        if f.endswith(".py"):
            shutil.copy(f"{root}/{f}", tmp_path)
    assert os.path.exists(tmp_path / "corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_equi' in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; s = e.oracle_sql(); assert set(s) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_engine.py"], cwd=tmp_path, check=True, env=env, timeout=600)
