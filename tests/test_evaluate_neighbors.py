"""Evaluation metrics, text and vector neighbours against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from readpaths.operators import evaluate as ev
from readpaths.operators import neighbors as nb
from readpaths.operators import vectors as vn


def test_target_ranks_first_absent_and_no_neighbours(spark):
    pairs = spark.createDataFrame([("a", 1, 10, 11), ("b", 1, 10, 99), ("c", 1, 20, 21)],
                                  "actor string, session_no int, src long, trg long")
    neigh = spark.createDataFrame([(10, 11, 1), (10, 12, 2)], "src long, nn long, rank int")
    got = {r["actor"]: r["rank"] for r in ev.target_ranks(pairs, neigh).collect()}
    assert got == {"a": 1.0, "b": 1e6, "c": 1e6}


def test_metrics_values_and_miss_weight(spark):
    ranks = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 1e6), ("d", 60.0)], "actor string, rank double")
    m = ev.next_page_metrics(ranks).collect()[0]
    assert m["n"] == 4
    assert m["mrr"] == pytest.approx((1 + 0.2 + 1e-6 + 1 / 60) / 4, abs=1e-9)
    assert (m["recall_at_1"], m["recall_at_10"], m["recall_at_50"], m["recall_at_100"]) == (0.25, 0.5, 0.5, 0.75)


def test_metrics_without_pairs(spark):
    ranks = spark.createDataFrame([], "actor string, rank double")
    m = ev.next_page_metrics(ranks).collect()[0]
    assert m["n"] == 0 and m["mrr"] is None


def test_metrics_json_keys(spark):
    import json

    ranks = spark.createDataFrame([("a", 1.0)], "actor string, rank double")
    line = ev.metrics_json(ev.next_page_metrics(ranks)).collect()[0]["json"]
    assert list(json.loads(line)) == ["N", "MRR", "Recall@1", "Recall@10", "Recall@50", "Recall@100"]


def test_query_pairs_consecutive_and_deterministic(spark):
    s = spark.createDataFrame([("a", 1, [5, 6, 7, 8]), ("b", 2, [1]), ("c", 3, [3, 4])],
                              "actor string, session_no int, page_ids array<long>")
    p1 = sorted(tuple(r) for r in ev.query_pairs(s, seed=3).collect())
    p2 = sorted(tuple(r) for r in ev.query_pairs(s, seed=3).collect())
    assert p1 == p2 and len(p1) == 2
    for actor, _, src, trg in p1:
        seq = {"a": [5, 6, 7, 8], "c": [3, 4]}[actor]
        assert seq.index(trg) == seq.index(src) + 1


def test_limit_pairs_semantics(spark):
    p = spark.createDataFrame([("a", i, i, i + 1) for i in range(5)], "actor string, session_no int, src long, trg long")
    assert ev.limit_pairs(p, None).count() == 5
    assert ev.limit_pairs(p, -1).count() == 5
    assert ev.limit_pairs(p, 0).count() == 0
    assert [r["session_no"] for r in ev.limit_pairs(p, 2).collect()] == [0, 1]


def test_pairs_from_lines(spark):
    lines = spark.createDataFrame([("1 2 3",), ("4",), (" 5 6 ",)], "value string")
    got = sorted((r["src"], r["trg"]) for r in ev.pairs_from_lines(lines, seed=1).collect())
    assert len(got) == 2 and (5, 6) in got


def test_equal_lines_draw_for_themselves(spark):
    lines = spark.createDataFrame([("1 2 3 4",)] * 600, "value string")
    got = Counter((r["src"], r["trg"]) for r in ev.pairs_from_lines(lines, seed=1).collect())
    assert sum(got.values()) == 600 and set(got) == {(1, 2), (2, 3), (3, 4)} and min(got.values()) > 120


def test_line_evaluation_of_two_inputs(spark):
    from readpaths.plans import jobs

    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red fox sleeps"), (3, "blue whale"), (4, "blue whale swims"), (9, "red fox")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, "d")], "page_id long, page_title string")
    inputs = {n: spark.createDataFrame(v, "value string") for n, v in {"dev": [("1 2",), ("1 2",)], "test": [("3 4",), ("7 1",)]}.items()}
    got = {r["input"]: r for r in jobs.line_evaluation(inputs, docs, pages, k=5, seed=1).collect()}
    # 9 is no page, so 2 is first for 1; a source without a title and one without a page have no neighbours
    assert (got["dev"]["n"], got["dev"]["mrr"], got["dev"]["recall_at_1"]) == (2, 1.0, 1.0)
    assert (got["test"]["n"], got["test"]["mrr"], got["test"]["recall_at_100"]) == (2, 1e-6, 0.0)


# ---------------------------------------------------------------- text neighbours
def brute_mlt(docs, k, max_terms=None):
    import re

    toks = {d: re.findall(r"[a-z0-9]+", t.lower()) for d, t in docs}
    n = len(docs)
    counts = {d: Counter(ws) for d, ws in toks.items()}
    df = Counter(w for c in counts.values() for w in c)
    weight = {d: {w: round(c * math.log(n / df[w]), 9) for w, c in cs.items()} for d, cs in counts.items()}
    weight = {d: {w: x for w, x in ws.items() if x > 0} for d, ws in weight.items()}
    out = {}
    for s in weight:
        q = sorted(weight[s].items(), key=lambda kv: (-kv[1], kv[0]))[:max_terms]
        scores = {}
        for d in weight:
            if d == s:
                continue
            shared = [ws * weight[d][t] for t, ws in q if t in weight[d]]
            if shared:
                scores[d] = round(sum(shared), 6)
        out[s] = [d for d, _ in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    return out


def test_more_like_this_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]
    docs = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 12)]) for _ in range(rng.randint(3, 30))))
            for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in nb.more_like_this(df, k=5, max_terms=4).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nn"])
    exp = {s: v for s, v in brute_mlt(docs, 5, 4).items() if v}
    assert got == exp


# ---------------------------------------------------------------- vector neighbours
def brute_cos(vecs, k, sources=None):
    ids = np.array(sorted(vecs))
    m = np.stack([np.asarray(vecs[i], dtype=np.float64) for i in ids])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for a, i in enumerate(ids):
        if sources is not None and i not in sources:
            continue
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("clusters,block", [(1, 2048), (6, 2048), (6, 7), (None, 2048)])
def test_vector_neighbors_exact(spark, clusters, block):
    rng = np.random.default_rng(5)
    # uneven clusters: one big blob plus small ones
    centers = rng.normal(size=(4, 8))
    vecs = {}
    for i in range(120):
        c = centers[0] if i < 70 else centers[i % 4]
        vecs[i] = (c + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(vecs.items()), "page_id long, vector array<float>")
    got = {}
    for r in vn.vector_neighbors(df, k=7, n_clusters=clusters, block=block).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nn"])
    vecs64 = {i: np.asarray(v, dtype=np.float32).astype(np.float64) for i, v in vecs.items()}
    assert got == brute_cos(vecs64, 7)


def test_vector_neighbors_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(vn, "CELLS", 20)
    test_vector_neighbors_exact(spark, 6, 16)


def test_vector_neighbors_for_sources_only(spark):
    rng = np.random.default_rng(1)
    vecs = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(50)}
    df = spark.createDataFrame(list(vecs.items()), "page_id long, vector array<float>")
    src = spark.createDataFrame([(3,), (17,)], "page_id long")
    out = vn.vector_neighbors(df, k=4, sources=src, n_clusters=3).collect()
    assert {r["src"] for r in out} == {3, 17}
    vecs64 = {i: np.asarray(v, dtype=np.float32).astype(np.float64) for i, v in vecs.items()}
    exp = brute_cos(vecs64, 4, sources={3, 17})
    got = {}
    for r in sorted(out, key=lambda r: (r["src"], r["rank"])):
        got.setdefault(r["src"], []).append(r["nn"])
    assert got == exp


@pytest.fixture()
def many_partitions(spark):
    """Shuffles keep their partitions: what must meet has to hash alike."""
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize(("clusters", "block"), [(6, 7), (None, 50)])
def test_vector_neighbors_with_many_partitions(spark, many_partitions, clusters, block):
    test_vector_neighbors_exact(spark, clusters, block)


@pytest.mark.parametrize(("max_terms", "postings"), [(None, 1 << 18), (None, 20), (5, 1 << 18), (5, 20)])
def test_more_like_this_blocks_agree_with_brute_force(spark, many_partitions, monkeypatch, max_terms, postings):
    monkeypatch.setattr(nb, "FIRST", 1)
    monkeypatch.setattr(nb, "SOURCES_PER_COPY", 9)
    rng = random.Random(11)
    vocab = [f"{chr(97 + i)}{chr(97 + j)}{i}" for i in range(6) for j in range(6)]
    docs = [(i, " ".join(rng.choice(vocab[: rng.randint(4, 36)]) for _ in range(rng.randint(2, 40)))) for i in range(60)]
    df = spark.createDataFrame([*docs, (60, None), (61, "")], "doc_id long, text string")
    got = {}
    for r in nb.more_like_this(df, k=6, max_terms=max_terms, block_postings=postings).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nn"])
    assert got == {s: v for s, v in brute_mlt([*docs, (60, ""), (61, "")], 6, max_terms).items() if v}


def mixed_docs(rng, n):
    """Documents of two vocabularies and very different lengths."""
    vocab = {x: [f"{x}{i}" for i in range(120)] for x in "ab"}
    return [(i, " ".join(rng.choice(vocab["a" if i % 3 else "b"]) for _ in range(int(4 * 1.5 ** rng.uniform(0, 11))))) for i in range(n)]


def test_search_scores_a_part_of_all_pairs(spark, monkeypatch):
    """Bands and blocks are skipped, and nothing is lost."""
    monkeypatch.setattr(nb, "FIRST", 4)
    rng, work = random.Random(5), {}
    for n in (150, 600):
        docs = mixed_docs(rng, n)
        df, scored = spark.createDataFrame(docs, "doc_id long, text string"), spark.sparkContext.accumulator(0)
        got = {}
        for r in nb.more_like_this(df, k=5, block_postings=2000, work=scored).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["nn"])
        assert got == {s: v for s, v in brute_mlt(docs, 5).items() if v}
        work[n] = scored.value
    assert all(scored < 0.3 * n * n for n, scored in work.items())


@pytest.mark.parametrize("postings", [1 << 18, 300])
def test_target_positions_are_those_of_the_lists(spark, monkeypatch, postings):
    monkeypatch.setattr(nb, "FIRST", 1)
    rng = random.Random(6)
    docs = [*mixed_docs(rng, 120), (500, "a1 a2 a3"), (501, "a1 a2 a3"), (502, "a1 a2 a3"), (503, "alone"), (504, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    allowed = spark.createDataFrame([(i,) for i, _ in docs if i % 7], "page_id long")
    k, lists = 12, {}
    for r in nb.more_like_this(df, k=k, candidates=allowed).collect():
        lists[r["src"], r["nn"]] = r["rank"]
    ids = [i for i, _ in docs]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(400)] + [(s, t) for s, t in list(lists)[::9]] + [(500, 501), (500, 502), (500, 500), (503, 500), (999, 1), (1, 999), (None, 1)]
    got = nb.target_positions(spark.createDataFrame(pairs, "src long, trg long"), df, k, candidates=allowed, block_postings=postings).collect()
    assert {(r["src"], r["trg"]): r["rank"] for r in got} == {p: lists[p] for p in set(pairs) if p in lists}


def test_text_neighbours_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nb.more_like_this(none).count() == 0
    assert nb.target_positions(spark.createDataFrame([(1, 2)], "src long, trg long"), none).count() == 0


def test_sources_are_not_shuffled_to_blocks(spark):
    """What is shuffled does not follow the number of (source, block) pairs."""
    docs = spark.createDataFrame(mixed_docs(random.Random(2), 60), "doc_id long, text string")
    _, asked, blocks = nb._prepared(docs, "doc_id", "text", None, None, None, 50)
    queries = asked.selectExpr("*", "0D as least", "cast(null as long) as trg")
    lists = nb._Lists(3)
    plan = nb._streamed(blocks, list(blocks.docs), queries, lists, lists.schema)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize(("many", "cells", "growth"), [(16, 1 << 20, 3), (1, 300, 1), (10**6, 1 << 20, 1)])
def test_rounds_and_bounds_lose_nothing(spark, monkeypatch, many, cells, growth):
    """Blocks come in rounds that leave k rows a source, and only what the bounds let through is scored: as rows of products or one by one."""
    for name, value in {"FIRST": 2, "GROWTH": growth, "MANY": many, "SCORE_CELLS": cells, "GROUPS": 4, "DENSE_SHARE": 12}.items():
        monkeypatch.setattr(nb, name, value)
    docs, written, real, k = mixed_docs(random.Random(9), 200), [], nb.stored, 5

    def stored(df, name):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(nb, "stored", stored)
    got = {}
    for r in nb.more_like_this(spark.createDataFrame(docs, "doc_id long, text string"), k=k, block_postings=800).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nn"])
    assert got == {s: v for s, v in brute_mlt(docs, k).items() if v}
    best = [n for name, n in written if name == "best"]
    assert len(best) > 2 and max(best) <= k * len(docs)


def test_bound_of_a_block_leaves_few_pairs_for_exact_sums():
    """With the k-th score known, the groups' norms and the rare terms rule out most pairs before their frequent terms are summed."""
    rng, n, terms = np.random.default_rng(4), 400, 300
    w = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0.0) + np.repeat(np.eye(40), 10, axis=0) @ (rng.random((40, terms)) < 0.05)
    doc, term = np.nonzero(w)
    order = np.lexsort((doc, term))
    row = {"ids": np.arange(n), "terms": term[order], "doc": doc[order].astype(np.int32), "weight": w[doc, term][order]}
    block = nb._Block({"band": 3} | {c: v.tobytes() for c, v in row.items()})
    exact = np.round(w @ w.T, 6)
    np.fill_diagonal(exact, -1.0)
    q = nb._Queries.__new__(nb._Queries)
    q.ids, q.norm, q.trg = np.arange(n), np.linalg.norm(w, axis=1), np.zeros(n, np.int64)
    q.cuts, q.terms, q.weight = np.searchsorted(doc, np.arange(n + 1)), term, w[doc, term]
    q.unique, q.place = np.unique(q.terms, return_inverse=True)
    for least in (np.zeros(n), np.partition(exact, -5, axis=1)[:, -5]):
        q.least = least
        got = {(int(a), int(b)): x for s, d, score in block.reaching(q, block.can_reach(q)) for a, b, x in zip(s, d, score, strict=True)}
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero((exact >= least[:, None]) & (exact > 0)), strict=True)}
        assert got.keys() == want and all(abs(x - exact[p]) < 2e-6 for p, x in got.items())
    most = nb._group_norms(block.dense) @ block.norms.T
    assert (most >= exact * 0.999 - w[:, block.terms[block.column < 0]] @ w[:, block.terms[block.column < 0]].T).all()
    assert (most >= least[:, None]).mean() < 0.3


def test_second_pass_copies_no_vector_for_a_cluster(spark, monkeypatch):
    """Even vectors, of which a source must visit most clusters: what is written holds no row for each visit, and the result is exact."""
    rng, written = np.random.default_rng(12), []
    vecs = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(700)}
    real, searched = vn.stored, vn.blocked_candidates

    def stored(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    def counted(probe, *rest):
        written.append(probe.count())
        return searched(probe, *rest)

    monkeypatch.setattr(vn, "stored", stored)
    monkeypatch.setattr(vn, "blocked_candidates", counted)
    got = {}
    for r in vn.vector_neighbors(spark.createDataFrame(list(vecs.items()), "page_id long, vector array<float>"), k=5, n_clusters=60, block=8).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nn"])
    assert got == brute_cos({i: np.asarray(v, dtype=np.float32).astype(np.float64) for i, v in vecs.items()}, 5)
    assert max(written) <= 5 * len(vecs)
