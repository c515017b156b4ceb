import math

import numpy as np
import pytest
from llm_frames import clashing, empty
from pyspark.sql import functions as F

from readpaths.llm import gnat as G

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(seed=0, n=900, dim=8, labels=4, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(int(i), (centres[i % 12] * rng.uniform(0.5, 2) + spread * rng.normal(size=dim)).tolist(), int(rng.integers(labels))) for i in range(n)]
    same = rows[5][1]
    return rows + [(i, same, i % 3) for i in range(n, n + 200)]


def plain(rows, step=10, positives=5, negatives=5):
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in good:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(near[:negatives], 1)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def mined(df, **kw):
    return answers(G.hard_negatives(df, F.col("label"), F.col("id") % 10 == 0, 5, 5, 80, **kw))


@pytest.mark.parametrize("shard_rows", [2, 100, 100_000])
@pytest.mark.parametrize("dim", [2, 8])
def test_against_all_pairs(spark, shard_rows, dim):
    rows = rows_of(dim=dim)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5), "row", "v", "cell", "score", "anchor")
    got = mined(df, shard_rows=shard_rows)
    assert got == plain(rows) and got


def test_ties_repeated_rows_and_one_hot_label(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(0, 3, size=3).astype(float).tolist(), 0 if i % 3 else int(i) % 4) for i in range(400)]
    rows += [rows[10], rows[10], rows[11], rows[13]]
    assert mined(spark.createDataFrame(rows, SCHEMA), shard_rows=50) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (10, None, 1), (20, [nan, 1.0], 1), (30, [inf, 1.0], 2), (40, [None, 1.0], 1), (50, [], 1), (None, [1.0, 1.0], 1), (60, [1.0, 1.0], None),
            (70, [0.0, 0.0], 1), (1, [0.9, 5.0], 1), (2, [0.8, -1.0], 2), (3, [0.9, 0.0], 3), (80, [2.0], 1), (81, [1.0], 1), (82, [0.9], 2), (90, [-1.0, 0.0], 5), (91, [1.0, 0.0], 5)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and {a for a, *_ in got} == {0, 70, 80}


def test_whole_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(1 << 19, 1 << 20, size=4)], int(i) % 3) for i in range(120)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    with pytest.raises(Exception, match="2\\^62|PythonException"):
        mined(spark.createDataFrame([(0, [1e160], 1)], SCHEMA))


def test_empty_table_and_no_anchor(spark):
    assert mined(empty(spark, SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_tree_prunes_and_loses_nothing():
    rows = rows_of(7, n=6000, dim=4, spread=0.1)
    ids, x, labels = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64), np.array([r[2] for r in rows])
    tree = G.Tree.load(G.Tree(ids, labels, x, leaf_rows=32).dump())
    q = np.flatnonzero(ids % 50 == 0)
    leaves = sum(1 for n in tree.nodes if not n[1])
    for same in (True, False):
        scores = x[q] @ x.T
        high = np.full(len(q), G.TOP) if same else np.sort(scores, axis=1)[:, -40]
        low = np.full(len(q), G.NONE) if same else high * 80 // 100
        tree.visits = 0
        best, found = tree.search(ids[q], labels[q], x[q], low, high, 5, same)
        assert tree.visits < 0.5 * len(q) * leaves
        for i, row in enumerate(q):
            fits = ((labels == labels[row]) == same) & (ids != ids[row]) & (scores[i] >= low[i]) & (scores[i] <= high[i])
            order = np.lexsort((ids, -scores[i]))
            want = [j for j in order if fits[j]][:5]
            assert found[i][: len(want)].tolist() == ids[want].tolist() and (best[i][len(want) :] == G.NONE).all()


def test_equal_vectors_and_a_hot_cell(spark):
    """A third of all rows are one vector: they are dealt to many shards, and ties go to the smaller id."""
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 17), 1.0], i % 2) for i in range(600)]
    index = G.Index(G.whole_numbers(spark.createDataFrame(rows, SCHEMA), F.col("label"), "vec_id", "embedding"), 50)
    assert max(r["n"] for r in index.trees.groupBy("cell").count().withColumnRenamed("count", "n").collect()) >= 8
    assert mined(spark.createDataFrame(rows, SCHEMA), shard_rows=50) == plain(rows)
