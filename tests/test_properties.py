"""Properties of whole-job outputs on the sf0.01 test tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from readpaths.functions.columns import epoch_micros
from readpaths.operators import evaluate as ev
from readpaths.operators import graph as gr
from readpaths.operators import sessions as ss
from readpaths.plans import catalog as C

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sessions(spark):
    return C._sessions(spark, SF).persist()


def test_no_page_twice_per_actor(sessions):
    per_actor = sessions.select("actor", F.explode("page_ids").alias("p")).groupBy("actor", "p").count()
    assert per_actor.where("count > 1").count() == 0


def test_lengths_in_window(sessions):
    row = sessions.agg(F.min("n_views").alias("lo"), F.max("n_views").alias("hi")).collect()[0]
    assert row["lo"] >= C.P.length[0] and row["hi"] <= C.P.length[1]


def test_gaps_within_sessions_at_most_dt(spark):
    firsts = ss.first_visits(C._joined(spark, SF, C.P.wiki).where(F.col("ts").isNotNull()))
    split = ss.gap_sessions(firsts, C.P.dt)
    w = Window.partitionBy("actor", "session_no").orderBy("ts", "page_id")
    gaps = split.withColumn("gap", epoch_micros("ts") - F.lag(epoch_micros("ts")).over(w))
    assert gaps.where(F.col("gap") > C.P.dt * 1_000_000).count() == 0
    # and consecutive sessions of an actor are more than dt apart
    s = split.groupBy("actor", "session_no").agg(F.min(epoch_micros("ts")).alias("lo"),
                                                 F.max(epoch_micros("ts")).alias("hi"))
    w2 = Window.partitionBy("actor").orderBy("session_no")
    between = s.withColumn("gap", F.col("lo") - F.lag("hi").over(w2))
    assert between.where(F.col("gap") <= C.P.dt * 1_000_000).count() == 0


def test_edges_unique_and_nodes_subset_of_endpoints(spark):
    edges = C._graph_edges(spark, SF)
    assert edges.count() == edges.distinct().count()
    nodes = C.q_graph_nodes(spark, SF)
    ends = gr.edge_endpoints(edges)
    assert nodes.join(ends, "page_id", "left_anti").count() == 0
    assert nodes.select("page_id").distinct().count() == nodes.count()


def test_metrics_ranges(spark):
    for m in ev.metrics_by_split(C._ranks(spark, SF)).collect():
        assert 0 < m["mrr"] <= 1
        assert m["recall_at_1"] <= m["recall_at_10"] <= m["recall_at_50"] <= m["recall_at_100"] <= 1


def test_neighbour_lists_ranked_and_unique(spark):
    nn = C.q_more_like_this(spark, SF)
    assert nn.where(F.col("src") == F.col("nn")).count() == 0
    assert nn.groupBy("src", "nn").count().where("count > 1").count() == 0
    w = Window.partitionBy("src").orderBy("rank")
    bad = nn.withColumn("prev", F.lag("score").over(w)).where(F.col("prev") < F.col("score"))
    assert bad.count() == 0
