import math
import re
import warnings
from collections import defaultdict

import pytest
from llm_frames import clashing, corpus, empty
from pyspark.sql import functions as F

from readpaths.llm import raking as R


def plain_rake(cells, targets, sweeps=R.SWEEPS):
    """Weights by key; ``targets`` are dictionaries by dimension number."""
    w = {k: float(v) for k, v in cells.items()}
    shares = []
    for d, t in enumerate(targets):
        there = {k[d] for k, v in cells.items() if v > 0}
        total = sum(v for k, v in t.items() if k in there) or 1
        shares.append({k: v / total for k, v in t.items() if k in there})
    for _ in range(sweeps):
        moved = 0
        for d, share in enumerate(shares):
            margin = defaultdict(float)
            for k, v in w.items():
                margin[k[d]] += v
            factor = {k: share.get(k, 0) / m if m > 0 else 1 for k, m in margin.items()}
            w = {k: v * factor[k[d]] for k, v in w.items()}
            moved = max([moved] + [abs(factor[k[d]] - 1) for k in w if w[k] > 0])
        if moved <= R.TOLERANCE:
            break
    total = sum(w.values()) or 1
    return {k: v / total for k, v in w.items()}


def frame(spark, cells):
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], "a string, b string, tokens long")


CELLS = {("x", "p"): 100, ("x", "q"): 900, ("y", "p"): 50, (None, "q"): 400, ("z", None): 10, ("y", "z"): 0}


def test_rake_matches_plain_fit_and_meets_targets(spark):
    cells = {**CELLS, ("y", "q"): 300, ("z", "p"): 20, (None, "p"): 60, ("x", None): 30}
    targets = [{"x": 1, "y": 2, None: 1, "z": 0.5, "absent": 9}, {"p": 3, "q": 2, None: 1}]
    frames = {n: spark.createDataFrame(list(t.items()), "value string, share double") for n, t in zip("ab", [{k: float(v) for k, v in t.items()} for t in targets], strict=True)}
    got = {(r["a"], r["b"]): r["weight"] for r in R.rake(frame(spark, cells), frames).collect()}
    want = plain_rake(cells, targets)
    assert got == pytest.approx(want, abs=1e-9)
    assert sum(v for k, v in got.items() if k[0] == "y") == pytest.approx(2 / 4.5, abs=1e-5) and sum(v for k, v in got.items() if k[1] == "p") == pytest.approx(0.5, abs=1e-5)


def test_values_without_target_get_nothing(spark):
    t = {n: spark.createDataFrame(rows, "value string, share double") for n, rows in (("a", [("x", 1.0), ("y", 1.0)]), ("b", [("p", 1.0), ("q", 1.0)]))}
    got = {(r["a"], r["b"]): r["weight"] for r in R.rake(frame(spark, CELLS), t).collect()}
    assert got[None, "q"] == got["z", None] == 0 and sum(got.values()) == pytest.approx(1)


def test_targets_that_cannot_be_met_are_reported(spark):
    """Value q of b has no cell beside x, which may have a tenth only."""
    t = {n: spark.createDataFrame(rows, "value string, share double") for n, rows in (("a", [("x", 0.1), ("y", 0.9)]), ("b", [("p", 0.2), ("q", 0.8)]))}
    cells = spark.createDataFrame([("x", "q", 5), ("x", "p", 5), ("y", "p", 5)], "a string, b string, tokens long")
    with pytest.warns(R.MarginWarning, match="largest error of a share: 0\\.[0-9]+"):
        R.rake(cells, t, sweeps=6).count()
    fine = {**t, "b": spark.createDataFrame([("p", 0.95), ("q", 0.05)], "value string, share double")}
    with warnings.catch_warnings():
        warnings.simplefilter("error", R.MarginWarning)
        R.rake(cells, fine).count()


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_calibrated_probabilities_meet_the_budget(spark, share):
    cells = spark.createDataFrame([("a", 1000, 0.5), ("b", 10, 0.4), ("c", 500, 0.1), ("d", 0, 0.0), ("e", 70, 0.0)], "k string, tokens long, weight double")
    budget = share * 1510
    got = {r["k"]: r["probability"] for r in R.calibrate(cells, budget).collect()}
    assert sum(got[k] * t for k, t in (("a", 1000), ("b", 10), ("c", 500))) == pytest.approx(budget, rel=1e-6)
    assert got["e"] == got["d"] == 0 and all(0 <= p <= 1 for p in got.values())
    open_ = [k for k in "abc" if got[k] < 1]
    wish = {"a": 0.5 / 1000, "b": 0.4 / 10, "c": 0.1 / 500}
    assert len({round(got[k] / wish[k], 6) for k in open_}) <= 1


def drawn(spark, docs, share=0.5, **kw):
    return R.mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": R.topic(F.col("text"))}, R.words(F.col("text")), share, **kw)


def test_mix_keeps_columns_and_is_the_same_on_any_partitioning(spark):
    docs = clashing(corpus(spark, n=120), "mix", "weight", "key", "row", "draw", "cell", "tokens")
    out = drawn(spark, docs)
    assert out.columns == [c for c in docs.columns if c != "mix"] + ["mix"]
    again = drawn(spark, docs.repartition(7))
    key = lambda r: str((r["doc_id"], r["source"], round(r["mix"]["probability"], 9)))
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect())) and 0 < out.count() < docs.count()


def test_mix_draws_the_target_shares(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("rare").alias("source"), F.lit("en").alias("lang"), F.lit("one two three").alias("text"))
    out = R.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, R.words(F.col("text")), 0.3)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    want = math.sqrt(0.8) / (math.sqrt(0.8) + math.sqrt(0.2))
    assert got["hot"] / sum(got.values()) == pytest.approx(want, abs=0.02) and sum(got.values()) == pytest.approx(12_000, rel=0.05)


def test_words_and_no_python(spark):
    texts = [None, "", " \t", "a", " a  b\u00a0c\nd ", "x\x00y"]
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.words(F.col("t")).alias("n")).collect()}
    assert got == {t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for t in texts}
    plan = drawn(spark, corpus(spark))._jdf.queryExecution().toString()
    assert not re.search("PythonUDF|Arrow|Pandas|BatchEvalPython", plan)


def test_empty_table(spark):
    assert drawn(spark, empty(spark)).count() == 0
    assert drawn(spark, spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0
