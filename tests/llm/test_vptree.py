import random

import numpy as np
import pytest
from llm_frames import clashing, empty
from pyspark.sql import functions as F

from readpaths.llm import vptree as V

SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed=0, n=700, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(int(i), (centres[i % 9] * rng.uniform(0.5, 2) + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[5][1]
    rows += [(i, same) for i in range(n, n + 150)]
    return rows


def plain(rows, k=20):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = [(-float(np.einsum("i,i->", v, w)), i) for i, w in good if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_factor_one_is_exact(spark, shard_rows):
    rows = vectors()
    got = answers(V.neighbours(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5), "score", "shard", "dim"), factor=1.0, shard_rows=shard_rows))
    want = plain(rows)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}
    assert all(g[1] == pytest.approx(w[1], rel=1e-12) for q in want for g, w in zip(got[q], want[q], strict=True))


def test_recall_of_the_production_factor(spark):
    rows = vectors(1, 3000, 16)
    got, want = answers(V.neighbours(spark.createDataFrame(rows, SCHEMA), shard_rows=800)), plain(rows)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9


def test_tree_prunes_and_larger_factors_visit_less():
    rows = vectors(2, 4000, 4)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    largest = float(np.sqrt((x**2).sum(axis=1).max()))
    tree, q = V.Tree.load(V.Tree(ids, x, largest, 32).dump()), np.flatnonzero(ids % 20 == 0)
    exact = [tree.search(ids[q], x[q], 20, f) for f in (1.0, 1.5, 3.0)]
    assert exact[0][2] < 0.7 * len(q) * len(tree.leaves) and exact[0][2] > exact[1][2] >= exact[2][2]
    for row, i in zip(exact[0][1][:20], q, strict=False):
        scores = x @ x[i]
        scores[i] = -np.inf
        assert row.tolist() == ids[np.lexsort((ids, -np.einsum("ij,j->i", x, x[i]), np.arange(len(ids)) == i))[:20]].tolist()


def test_one_huge_component(spark):
    """A row whose square is beyond all doubles costs the others neither neighbours nor pruning's correctness."""
    rows = [(i, [float(x) for x in v]) for i, v in vectors(4, 3000, 8)] + [(9001, [1e160] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(V.neighbours(df, shard_rows=800)), plain(rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.99
    exact = answers(V.neighbours(df, shard_rows=800, factor=1.0))
    assert {q: [i for i, _ in a] for q, a in exact.items()} == {q: [i for i, _ in a] for q, a in want.items()}


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 1.0]), (80, [1.0]), (81, [3.0]), (0, [1.0, 0.0]), (100, []),
            (120, [float("inf"), 1.0]), (140, [None, 1.0]), (160, [-1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0])]
    got = answers(V.neighbours(spark.createDataFrame(rows, SCHEMA), k=4))
    assert got[0] == [(3, 2.0), (4, 2.0), (5, 2.0), (5, 2.0)] and got[80] == [(81, 3.0)]
    assert got[160] == [(0, -1.0), (0, -1.0), (3, -2.0), (4, -2.0)] and set(got) == {0, 80, 160}


def test_empty_table_and_no_queries(spark):
    assert V.neighbours(empty(spark, SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert V.neighbours(one).count() == 0 and V.neighbours(one, query=F.col("id") == 1).count() == 0


def test_any_query_set(spark):
    rows = [(i, [random.Random(i).random(), 1.0]) for i in range(50)]
    got = answers(V.neighbours(spark.createDataFrame(rows, SCHEMA), k=3, query=F.col("id") < 5, factor=1.0))
    assert set(got) == set(range(5))
