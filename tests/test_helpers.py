"""Helpers: checkpoint folder, cluster sizing, sinks."""

from readpaths.session import checkpoint_dir, scale_conf


def test_checkpoint_dir_keeps_the_session_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert checkpoint_dir(spark) == base.rstrip("/")
    sub = checkpoint_dir(spark, "x")
    assert sub.startswith(base.rstrip("/") + "/x-") and sub != checkpoint_dir(spark, "x")


def test_buckets_are_exact(spark):
    from readpaths.functions.columns import bucket_of

    us = [0, 1, 9_007_199_254_740_993, 3_600_000_000 * 2_500_000 - 1, -1, -3_600_000_000]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "us long").select(bucket_of("us", 3_600_000_000)).collect()]
    assert got == [u // 3_600_000_000 for u in us]


def test_scale_conf_sizes_partitions():
    conf = scale_conf(100 * 1024 ** 4)
    assert conf["spark.sql.shuffle.partitions"] == "100000"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "200"


def test_metrics_json_sink_and_read_table(spark, tmp_dir):
    import json
    import os

    from readpaths.operators import evaluate as ev
    from readpaths.sinks import writers as wr
    from readpaths.sources import tables as tb

    ranks = spark.createDataFrame([("a", 1.0), ("b", 1e6)], "actor string, rank double")
    out = os.path.join(tmp_dir, "metrics")
    wr.write_metrics_json(ev.metrics_json(ev.next_page_metrics(ranks)), out)
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert lines == [{"N": 2, "MRR": 0.5000005, "Recall@1": 0.5, "Recall@10": 0.5, "Recall@50": 0.5,
                      "Recall@100": 0.5}]
    path = os.path.join(tmp_dir, "t")
    ranks.write.parquet(path)
    assert tb.read_table(spark, path).count() == 2
