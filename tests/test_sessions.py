"""Session operators on hand-made frames (edge cases of the reference job)."""

import datetime as dt
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readpaths import oracle as O
from readpaths.operators import sessions as ss

SCHEMA = "actor string, ts timestamp, page_id long, page_title string, wiki_db string, qid string"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def views(spark, rows):
    return spark.createDataFrame(
        [(a, ts, p, f"page_{p}" if p is not None else None, "enwiki", q) for a, ts, p, q in rows], SCHEMA)


def lines(df):
    return sorted((r["actor"], r["line"]) for r in df.collect())


def secs(s, us=0):
    return T0 + dt.timedelta(seconds=s, microseconds=us)


def test_gap_exactly_dt_keeps_session(spark):
    df = views(spark, [("a", secs(0), 1, None), ("a", secs(3600), 2, None)])
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [("a", "1 2")]


def test_gap_dt_plus_one_microsecond_splits(spark):
    df = views(spark, [("a", secs(0), 1, None), ("a", secs(3600, 1), 2, None), ("a", secs(3601), 3, None)])
    # first session has one view and is dropped; second holds 2 and 3
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [("a", "2 3")]


def test_revisit_keeps_first_occurrence(spark):
    df = views(spark, [("a", secs(0), 1, None), ("a", secs(10), 2, None), ("a", secs(20), 1, None),
                       ("a", secs(30), 3, None)])
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [("a", "1 2 3")]


def test_dedupe_over_whole_actor_not_session(spark):
    # page 1 seen again in a later session: the later view is gone before splitting
    df = views(spark, [("a", secs(0), 1, None), ("a", secs(10), 2, None),
                       ("a", secs(20000), 1, None), ("a", secs(20010), 3, None), ("a", secs(20020), 4, None)])
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [("a", "1 2"), ("a", "3 4")]


def test_null_ts_dropped_before_everything(spark):
    df = views(spark, [("a", None, 9, "Q5296"), ("a", secs(0), 1, None), ("a", secs(5), 2, None)])
    # the blacklisted view has no timestamp, so the actor stays
    assert lines(ss.reading_sessions(df, 3600)) == [("a", "1 2")]


def test_null_actor_is_one_group(spark):
    df = views(spark, [(None, secs(0), 1, None), (None, secs(5), 2, None), ("b", secs(0), 3, None)])
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [(None, "1 2")]


def test_equal_ts_ordered_by_page(spark):
    df = views(spark, [("a", secs(0), 5, None), ("a", secs(0), 3, None), ("a", secs(0), 4, None)])
    assert lines(ss.reading_sessions(df, 3600, blacklist=None)) == [("a", "3 4 5")]


def test_length_window_drops_not_cuts(spark):
    rows = [("a", secs(i), i, None) for i in range(30)] + [("b", secs(i), i, None) for i in range(31)]
    out = ss.reading_sessions(views(spark, rows), 3600, blacklist=None).collect()
    assert [(r["actor"], r["n_views"]) for r in out] == [("a", 30)]


def test_blacklist_drops_whole_actor(spark):
    rows = [("a", secs(0), 1, "Q1"), ("a", secs(10), 2, "Q2"),             # session 1
            ("a", secs(50000), 3, "Q5296"), ("a", secs(50010), 4, "Q4"),   # session 2 has the main page
            ("b", secs(0), 1, "Q1"), ("b", secs(10), 2, "Q2")]
    assert lines(ss.reading_sessions(views(spark, rows), 3600)) == [("b", "1 2")]


def test_blacklist_as_dataframe(spark):
    rows = [("a", secs(0), 1, "Q7"), ("a", secs(10), 2, "Q2"), ("b", secs(0), 1, "Q1"), ("b", secs(10), 2, "Q2")]
    bl = spark.createDataFrame([("Q7",)], "qid string")
    assert lines(ss.reading_sessions(views(spark, rows), 3600, blacklist=bl)) == [("b", "1 2")]


def test_session_numbers_count_dropped_sessions(spark):
    rows = [("a", secs(0), 1, None), ("a", secs(10000), 2, None), ("a", secs(10010), 3, None)]
    out = ss.reading_sessions(views(spark, rows), 3600, blacklist=None).collect()
    assert [(r["session_no"], r["line"]) for r in out] == [(2, "2 3")]


def test_gap_sessions_no_filter_keeps_singletons(spark):
    rows = [("a", secs(0), 1, None), ("a", secs(10000), 2, None)]
    out = ss.gap_sessions(views(spark, rows), 3600).collect()
    assert sorted((r["page_id"], r["session_no"], r["session_length"]) for r in out) == [(1, 1, 1), (2, 2, 1)]


def test_actor_sequences_sorted_with_null_ts_first(spark):
    rows = [("a", secs(10), 2, None), ("a", None, 7, None), ("a", secs(0), 1, None)]
    seq = ss.actor_sequences(views(spark, rows), 10).collect()[0]["session"]
    assert [e["page_id"] for e in seq] == [7, 1, 2]


# ---------------------------------------------------------------- against SQL
def sql_sessions(rows, dt_s, blacklist=("Q5296",)):
    """``actor, line`` of the same views by window functions in DuckDB (the oracle's statements)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE joined (actor VARCHAR, ts TIMESTAMP, page_id BIGINT, page_title VARCHAR, wiki_db VARCHAR, qid VARCHAR)")
    if rows:
        con.executemany("INSERT INTO joined VALUES (?, ?, ?, ?, 'enwiki', ?)", [(a, ts, p, f"page_{p}", q) for a, ts, p, q in rows])
    items = " UNION ALL ".join(f"SELECT '{q}'" for q in blacklist) or "SELECT NULL WHERE false"
    ctes = (O.blacklist_cte("joined", items), O.first_visits_cte("kept"), O.split_cte("firsts", dt_s), O.lines_cte("split", 2, 30))
    return sorted(con.execute(O.with_(*ctes) + " SELECT actor, line FROM lines").fetchall(), key=repr)


def check_properties(rows, got, dt_s):
    """What any right answer has: lengths, first visits only, gaps within and between sessions."""
    first = {}
    for a, ts, p, _ in rows:
        if ts is not None:
            first[a, p] = min(first.get((a, p), ts), ts)
    seen = set()
    for actor, line in got:
        pages = [int(p) for p in line.split()]
        times = [first[actor, p] for p in pages]
        assert 2 <= len(pages) <= 30 and times == sorted(times)
        assert all((y - x).total_seconds() <= dt_s for x, y in zip(times, times[1:], strict=False))
        assert not seen & {(actor, p) for p in pages}
        seen |= {(actor, p) for p in pages}
        before = [t for (a, p), t in first.items() if a == actor and t < times[0] and p not in pages]
        assert not before or (times[0] - max(before)).total_seconds() > dt_s


view_rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]),
              st.one_of(st.none(), st.integers(0, 20000)),
              st.integers(0, 12),
              st.sampled_from([None, "Q1", "Q2", "Q5296"])),
    min_size=0, max_size=40)


@settings(max_examples=12, deadline=None)
@given(view_rows, st.sampled_from([60, 600, 3600]))
def test_matches_sql_and_has_the_properties(spark, rows, dt_s):
    rows = [(a, None if s is None else secs(s), p, q) for a, s, p, q in rows]
    got = sorted(((r["actor"], r["line"]) for r in
                  ss.reading_sessions(views(spark, rows), dt_s).collect()), key=repr)
    assert got == sql_sessions(rows, dt_s)
    check_properties(rows, got, dt_s)


def test_one_large_actor(spark):
    rng = random.Random(7)
    rows = [("x", secs(rng.randint(0, 200000)), rng.randint(0, 400), None) for _ in range(2000)]
    got = sorted(((r["actor"], r["line"]) for r in
                  ss.reading_sessions(views(spark, rows), 900, blacklist=None).collect()), key=repr)
    assert got == sql_sessions(rows, 900, blacklist=())
    check_properties(rows, got, 900)


def test_flag_on_the_item_map_is_the_same(spark):
    rows = [("a", secs(0), 1, "Q1"), ("a", secs(10), 2, "Q7"), ("b", secs(0), 1, "Q1"), ("b", secs(10), 3, "Q3")]
    df = views(spark, rows)
    bl = spark.createDataFrame([("Q7",), ("Q7",)], "qid string")
    flagged = ss.flag_blacklisted(df, bl)
    assert lines(ss.reading_sessions(flagged, 3600, blacklist=None)) == lines(ss.reading_sessions(df, 3600, blacklist=bl)) == [("b", "1 3")]


def test_actor_sequences_refuse_an_unbounded_actor(spark):
    df = views(spark, [("a", secs(i), i, None) for i in range(5)])
    assert ss.actor_sequences(df, 5).count() == 1
    with pytest.raises(Exception, match="more than 4 views"):
        ss.actor_sequences(df, 4).collect()


def test_views_of_a_hot_page_are_split(spark):
    from readpaths.operators import items as it

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = spark.range(60_000).repartition(6).select(F.when(F.col("id") % 20 == 0, F.col("id") % 50).otherwise(7).alias("page_id"), F.lit("enwiki").alias("wiki_db"), F.rand(1).alias("x"))
        links = spark.range(50).select(F.lit("enwiki").alias("wiki_db"), F.col("id").alias("page_id"), F.lit("2024-01-01").alias("snapshot"), F.col("id").cast("string").alias("item_id"))
        out = it.views_with_item(hot, it.latest_item(links))
        assert len(out.collect()) == 60_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
