"""Every query of the library itself against its SQL, on the smallest tables."""

import datetime as dt
import math
import os
import subprocess
import sys

import duckdb
import pytest

from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Trained or approximate: tested by brute force or held-out figures.
WITHOUT_SQL = {"ann_topk", "learned_dense_topk", "ranker_topk"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if isinstance(v, dt.date) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == sorted(df.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def test_plans(spark, small):
    """Filters and columns reach the scan; ranking is pruned before the shuffle."""
    from quarry.plans.retrieval import vector_topk_filtered

    plan = vector_topk_filtered(spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan or "EqualTo(label,3)" in plan
    assert "WindowGroupLimit" in plan


def test_without_the_optional_subpackage(tmp_path):
    """The registry works when the subpackage and the pipeline are not there."""
    code = "import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=60)


def test_registry():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == WITHOUT_SQL
