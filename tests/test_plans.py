"""Physical-plan properties: pruning and pushdown (test_oracle.py looks for cross joins in every plan)."""

import contextlib
import io

from readpaths.operators import filters as flt
from readpaths.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan_text(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_time_range_prunes_partitions_and_filters_reach_scan(spark, tmp_dir):
    path = f"{tmp_dir}/pv"
    fx.pageviews(spark, SF).write.partitionBy("year", "month", "day", "hour").parquet(path)
    pv = spark.read.parquet(path)
    v = flt.pageview_filters(flt.hour_range_filter(pv, "2024-01-03", "2024-01-05"), "enwiki")
    text = plan_text(v.select("actor", "ts", "page_id", "wiki_db"))
    part = [ln for ln in text.splitlines() if ln.startswith("PartitionFilters")][0]
    pushed = [ln for ln in text.splitlines() if ln.startswith("PushedFilters")][0]
    schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")][0]
    assert "make_timestamp" not in part and "year" in part and "month" in part
    assert "EqualTo(agent_type,user)" in pushed and "normalized_host.project_family" in pushed
    assert "pageview_info" not in schema
