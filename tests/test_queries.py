"""Every query of the library against its SQL in DuckDB, and plans that must hold at scale."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loomline.plans import aggregates, effects, extras, patterns, sequences  # noqa: F401
from loomline.plans.registry import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{round(v, 6) + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted("|".join(_cell(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted("|".join(_cell(r[c]) for c in sorted(columns)) for r in rows) == expected


def test_random_recall_by_replaying(spark, sf, duck):
    """Every element recalls one of its own type that was seen by then, the one that the same seed gives in a plain loop."""
    import random
    from collections import defaultdict

    found = {r.event_id: r.recalled for r in QUERIES["random_recall"](spark, sf).collect()}
    rng, seen = defaultdict(lambda: random.Random(7)), defaultdict(list)
    for i, kind in duck.execute("select event_id, event_type from events order by event_id").fetchall():
        seen[kind] = [*seen[kind], i]
        assert found.pop(i) == rng[kind].choice(seen[kind])
        seen[kind] = seen[kind][-64:]
    assert not found


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = _plan(QUERIES["filter_map_reduce"](spark, sf))
    assert "GreaterThanOrEqual(l_discount" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


def test_slices_need_no_window(spark, sf):
    for name in ("take_first", "take_last_events", "take_while_small", "drop_while_not_buying", "reduce_if_error", "abort_if_error", "drop_first", "unique_users"):
        assert "Window" not in _plan(QUERIES[name](spark, sf)), name


@pytest.mark.parametrize("pipeline", [True, False])
def test_library_stands_without_the_subpackage(tmp_path, pipeline):
    """What remains when the corpus operators are taken away, with their pipeline or before it, still imports."""
    _copy(tmp_path, "llm", "__pycache__")
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_missing_dependency_is_not_hidden(tmp_path):
    if not (ROOT / "loomline" / "llm").exists():
        pytest.skip("the subpackage is not there")
    _copy(tmp_path, "__pycache__")
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode and "xxhash" in out.stderr


def _copy(to, *without):
    shutil.copytree(ROOT / "loomline", to / "loomline", ignore=shutil.ignore_patterns(*without))
    shutil.copy(ROOT / "__spark_entry__.py", to)
