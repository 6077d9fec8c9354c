"""Every query against its SQL on the smallest tables, and the shape of key plans."""

import os

import pytest

from check_queries import compare, connect
from flowloom.catalog import load_catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_catalog()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert compare(QUERIES[name](spark, SF_DIR), db.sql(ORACLES[name])) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize(
    "name", ["graph_edges", "token_sequences", "traj_build", "neighbour_mean", "split_summary"]
)
def test_plan_stays_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_edges_take_one_window(spark):
    text = plan(QUERIES["graph_edges"](spark, SF_DIR))
    assert text.count("Window [") == 2  # node numbers, neighbours
    # Chains and edges are nested in graphs, so one exchange serves all three steps.
    assert text.count("Exchange hashpartitioning") == 1


def test_tail_cap_prunes_before_the_shuffle(spark):
    text = plan(QUERIES["token_sequences"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


def test_split_summary_is_one_expand(spark):
    text = plan(QUERIES["split_summary"](spark, SF_DIR))
    assert text.count("Expand ") == 1


def test_graph_summary_reads_three_columns(spark):
    text = plan(QUERIES["graph_summary"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_clean_table_parses_the_raw_files_once(spark, monkeypatch):
    from flowloom.operators import cleaning

    seen = []
    check = cleaning.drop_duplicate_column
    monkeypatch.setattr(
        cleaning, "drop_duplicate_column", lambda df, *names: seen.append(plan(df)) or check(df, *names)
    )
    assert QUERIES["files_clean_table"](spark, SF_DIR).count() > 0
    assert len(seen) == 1 and "FileScan csv" not in seen[0]
