"""Every registered query against its DuckDB oracle on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

from readpaths import session
from readpaths.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


# found by random planes: tests/test_vector_hashing.py compares it with brute force
WITHOUT_SQL = {"vector_neighbors_hashed"}


def test_every_query_has_an_oracle_and_is_registered():
    assert set(QUERIES) == set(ORACLE) | WITHOUT_SQL and set(QUERIES) <= set(entry.queries())


def test_hashed_neighbors_of_the_test_table(spark):
    """At least 0.9 of the exact neighbours, each with its exact score."""
    exact = {(r["src"], r["nn"]): r["score"] for r in QUERIES["vector_neighbors"](spark, SF_DIR).collect()}
    got = {(r["src"], r["nn"]): r["score"] for r in QUERIES["vector_neighbors_hashed"](spark, SF_DIR).collect()}
    both = exact.keys() & got.keys()
    assert len(got) == len(exact) and len(both) >= 0.9 * len(exact)
    assert all(abs(exact[x] - got[x]) < 2e-9 for x in both)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ok, msg = compare(df, con, ORACLE[name])
    assert ok, msg


# queries whose plans join, group or cogroup under keys of their own
KEYED = ["blacklist_actors", "graph_nodes", "line_pairs", "more_like_this", "reading_sessions", "text_vectors", "vector_target_ranks", "views_with_item"]


@pytest.mark.parametrize("name", KEYED)
def test_query_matches_oracle_with_many_partitions(spark, con, name, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    monkeypatch.setitem(session.REQUIRED_CONF, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ok, msg = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["actor", "session_no", "n_views", "line"]
    assert df.count() >= 0
