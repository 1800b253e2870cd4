"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_point
from slipway.plans.oracle import ORACLES as REGISTERED_SQL
from slipway.plans.registry import QUERIES as REGISTERED

QUERIES = dict(REGISTERED)
ORACLES = dict(REGISTERED_SQL)
# These run while they are built; what they return only reads their table.
STREAMS = ("run_outcome_stream", "spend_alerts", "settled_decisions", "spend_crossings", "readiness_decisions")


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    names, found = spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = duck_rows(connection, ORACLES[name])
    assert names == expected_names
    assert found == expected
    assert found


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_no_query_pairs_everything(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_has_one_shuffle_with_partial_sums(spark):
    plan = _plan(entry_point.entry(spark))
    assert plan.count("Exchange") == 1
    assert "partial_sum" in plan


@pytest.mark.parametrize(
    "name",
    ["estimate_memory", "gpu_fit_table", "candidate_gpus", "gpu_type_ids", "log_tail", "log_entries", "check_syntax"],
)
def test_row_local_queries_do_not_shuffle(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    plan = _plan(QUERIES["infer_command"](spark, sf_dir))
    assert "html" not in plan
    plan = _plan(QUERIES["param_rollup"](spark, sf_dir))
    assert "l_shipdate" not in plan and "l_extendedprice" in plan
