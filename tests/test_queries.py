"""Every registered query against its SQL twin, and its plan."""

import pytest

import __spark_entry__ as entry
import oracle
from watchtide import plans

# The text operators have tests of their own.
QUERIES, SQL = plans.QUERIES, plans.ORACLES
ROWS_ONLY = {"iforest_train", "iforest_score", "hybrid_score_trained", "chunk_text"}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, folder, name):
    diff, _, _ = oracle.compare(spark, duck, folder, name, QUERIES[name], SQL.get(name))
    # At the smallest scale some reports are rightly empty.
    assert diff in (None, "no rows") if name not in SQL else diff is None, diff


def test_only_random_or_free_form_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_entry(spark):
    df = entry.entry(spark)
    assert {"org", "bin", "z"} <= set(df.columns)
    assert df.count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


STREAMED = [n for n in QUERIES if n.startswith("stream_")]
# These run a model or fetch a bounded query set while the plan is built.
EAGER = {*STREAMED, "iforest_score", "hybrid_score_trained", "vector_search_many"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_cross_joins(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_python_stages_run_from_another_folder(tmp_path):
    """Workers started elsewhere have no copy of the package; the code is sent along."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2')"
        ".config('spark.checkpoint.dir', sys.argv[3]).getOrCreate()\n"
        "for n in 'alert_cooldown hourly_rate_limit chunk_text iforest_train'.split():\n"
        "    assert e.queries()[n](s, sys.argv[2]).count() > 0, n\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    args = [sys.executable, "-c", code, repo, "/root/testdata/sf0.001", str(tmp_path / "shared")]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
