"""Multi-probe tables against brute force."""

import numpy as np
import pytest

from readpaths.operators import vector_hashing as vh


def brute(vecs, k, sources=None):
    ids = sorted(i for i, v in vecs.items() if v is not None and np.any(v))
    u = np.array([np.asarray(vecs[i], np.float32).astype(float) for i in ids])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    out = {}
    for a, i in enumerate(ids):
        if sources is None or i in sources:
            order = sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i)[:k]
            out[i] = [(j, -x) for x, j in order]
    return out


def frame(spark, vecs):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vecs.items()], "page_id long, vector array<float>").repartition(5)


def found(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append((r["nn"], r["score"]))
        assert r["rank"] == len(out[r["src"]])
    return out


def clustered(rng, n=1200, dim=24):
    centres = rng.standard_normal((40, dim))
    return {int(i): centres[i % 40] + 0.4 * rng.standard_normal(dim) for i in range(n)}


def recall(got, want):
    hits = [len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items() if w]
    return float(np.mean(hits))


@pytest.mark.parametrize("shape", ["clustered", "even"])
def test_recall_and_exact_scores(spark, shape):
    rng = np.random.default_rng(3)
    vecs = clustered(rng) if shape == "clustered" else {i: rng.standard_normal(16) for i in range(1000)}
    want, got = brute(vecs, 10), found(vh.vector_neighbors_hashed(frame(spark, vecs), k=10, bucket=64, block=200))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert recall(got, want) >= 0.9
    score = {(i, j): s for i, w in brute(vecs, len(vecs)).items() for j, s in w}
    for i, pairs in got.items():
        assert all(s == pytest.approx(score[i, j], abs=2e-9) for j, s in pairs)


def test_tables_leave_most_pairs_alone_on_clusters(spark):
    vecs = clustered(np.random.default_rng(5), n=2000)
    units = vh.unit_vectors(frame(spark, vecs))
    search = vh.tuned(units, k=10, bucket=64)
    assert search.bits == 5 and search.recall >= vh.RECALL and search.probes < 8
    u = np.array([r["u"] for r in units.collect()])
    meets = np.zeros((len(u), len(u)), bool)
    for p in search.planes:
        codes = vh._codes(u @ p)
        for row, c in enumerate(vh._probe_codes(u @ p, search.probes)):
            meets[row] |= np.isin(codes, c)
    assert meets.mean() < 0.6


def test_probes_are_ordered_by_cost_and_meeting_counts_them():
    rng = np.random.default_rng(0)
    s, m = rng.standard_normal((6, 7)), rng.standard_normal((50, 7))
    at = vh._meeting_probe(s, m)
    visits = vh._probe_codes(s, 1 << 7)
    for i in range(6):
        assert visits[i][0] == vh._codes(s[i:i + 1])[0] and sorted(visits[i]) == list(range(1 << 7))
        for j, c in enumerate(vh._codes(m)):
            assert visits[i][at[i, j]] == c


def test_copies_in_great_number_ties_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    vecs = {i: rng.standard_normal(8) for i in range(300)}
    same = rng.standard_normal(8)
    vecs |= {1000 + i: same for i in range(400)}
    vecs |= {5000: None, 5001: np.zeros(8), 5002: same * 2}
    want, got = brute(vecs, 5), found(vh.vector_neighbors_hashed(frame(spark, vecs), k=5, bucket=50, recall=1.0))
    # 2 * same scales to the same unit vector but for rounding; scores agree in any case
    assert set(got) == set(want)
    for i in (1000, 1001, 1003, 1399):
        assert [s for _, s in got[i]] == pytest.approx([1.0] * 5) and i not in {j for j, _ in got[i]}
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
    assert recall(got, want) >= 0.99


def test_sources_only_few_rows_and_empty(spark):
    rng = np.random.default_rng(2)
    vecs = {i: rng.standard_normal(8) for i in range(30)}
    ask = spark.createDataFrame([(3,), (3,), (17,), (99,)], "id long")
    got = found(vh.vector_neighbors_hashed(frame(spark, vecs), k=4, sources=ask))
    want = brute(vecs, 4, {3, 17})
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    few = found(vh.vector_neighbors_hashed(frame(spark, {1: [1, 0], 2: [0, 1]}), k=4))
    assert few == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    one = vh.vector_neighbors_hashed(frame(spark, {1: [1.0, 2.0]}), k=4)
    none = vh.vector_neighbors_hashed(frame(spark, {}), k=4)
    assert one.count() == 0 and none.count() == 0 and none.columns == ["src", "nn", "score", "rank"]


def test_too_many_bits_are_given_up(spark):
    """Where no probe of the weak signs reaches the recall, the tables get fewer bits."""
    rng = np.random.default_rng(4)
    units = vh.unit_vectors(frame(spark, {i: rng.standard_normal(48) for i in range(600)}))
    search = vh.tuned(units, k=20, recall=1.0, tables=1, bucket=0.1)
    assert search.bits < 13 and search.recall == 1.0


def test_rounds_leave_few_rows_on_disk_however_many_buckets_are_visited(spark, monkeypatch):
    """Even vectors: most buckets are visited; no table that is written holds a row for each visit, and the result is that of the visits."""
    rng = np.random.default_rng(11)
    vecs = {i: rng.standard_normal(32) for i in range(900)}
    written = []
    real = vh.stored

    def stored(df, name):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(vh, "stored", stored)
    units = vh.unit_vectors(frame(spark, vecs))
    search = vh.tuned(units, k=10, bucket=16)
    got = found(vh.vector_neighbors_hashed(frame(spark, vecs), k=10, bucket=16, block=64))
    assert vh.TABLES * search.probes > 50 and max(n for _, n in written) <= 10 * len(vecs)
    ids = np.array(sorted(vecs))
    u = {r["page_id"]: r["u"] for r in units.collect()}
    u = np.array([u[i] for i in ids])
    meets = np.zeros((len(u), len(u)), bool)
    for p in search.planes:
        codes = vh._codes(u @ p)
        for row, c in enumerate(vh._probe_codes(u @ p, search.probes)):
            meets[row] |= np.isin(codes, c)
    s = np.round(u @ u.T, 9)
    for a, i in enumerate(ids):
        want = sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i and meets[a, b])[:10]
        assert [j for j, _ in got[i]] == [j for _, j in want]


@pytest.mark.parametrize("lookup", [0, 1 << 20])
def test_both_ways_of_meeting_agree(monkeypatch, lookup):
    """Looked-up buckets and compared costs give the same pairs, with and without floors."""
    rng = np.random.default_rng(1)
    u, own = rng.standard_normal((300, 12)), rng.standard_normal((40, 12))
    u, own = (x / np.linalg.norm(x, axis=1)[:, None] for x in (u, own))
    search = vh.Search(vh._planes(3, 12, 6, 2), 5, 1.0)
    monkeypatch.setattr(vh, "LOOKUP", lookup)
    ids, src = np.arange(300), np.arange(1000, 1040)
    meets = np.zeros((40, 300), bool)
    for p in search.planes:
        for row, c in enumerate(vh._probe_codes(own @ p, 5)):
            meets[row] |= np.isin(vh._codes(u @ p), c)
    score = np.round(own @ u.T, 9)
    for floor in (-2.0, 0.1, 0.7):
        s = vh._Sources(search, src.tobytes(), own.tobytes(), src[::-1], np.full(40, floor))
        i, j, got = vh._met(s, [(u @ p > 0).astype(float) for p in search.planes], u, ids, slice(0, 40), 300)
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(meets & (score >= floor))), strict=True)}
        assert np.abs(got - score[i, j]).max(initial=0) < 2e-9


def test_floors_rise_within_a_task(monkeypatch):
    """The blocks of a pack of members follow each other; from the second on few pairs are scored, and a task returns k rows a source."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    u = rng.standard_normal((1200, 16))
    u /= np.linalg.norm(u, axis=1)[:, None]
    search, ids, real, scored = vh.Search(vh._planes(1, 16, 0, 2), 1, 1.0), np.arange(1200), vh.pair_scores, []
    monkeypatch.setattr(vh, "pair_scores", lambda a, b, i, j: scored.append(len(i)) or real(a, b, i, j))
    cells = {"pack": [0], "ids": [ids[:200].tobytes()], "u": [u[:200].tobytes()], "asked": pa.array([None], pa.list_(pa.int64())), "floors": pa.array([None], pa.list_(pa.float64())),
             "member_ids": [ids.tobytes()], "member_u": [u.tobytes()]}
    out = pa.Table.from_batches(list(vh._product_fn(search, 10, 100)(iter([pa.RecordBatch.from_pydict(cells)]))))
    score = np.round(u[:200] @ u.T, 9)
    score[np.arange(200), np.arange(200)] = -np.inf
    want = {(i, int(j)) for i in range(200) for j in np.lexsort((ids, -score[i]))[:10]}
    assert set(zip(out["src"].to_pylist(), out["nn"].to_pylist(), strict=True)) == want and out.num_rows == 2000
    assert 0 < sum(scored) < 0.1 * score.size
