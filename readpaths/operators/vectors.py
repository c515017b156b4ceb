"""Exact cosine top-k neighbours over a vector table (K8).

No cross join: vectors are grouped into k-means clusters and a source
only meets the members of clusters that can still hold one of its top-k
neighbours.  For unit vectors ``cos(q, x) = 1 - |q - x|^2 / 2`` and, for a
member ``x`` of cluster ``c`` with centre ``m`` and radius ``r``,
``|q - x| >= |q - m| - r``; so ``1 - max(0, |q - m| - r)^2 / 2`` bounds
the cosine of every member of ``c``.

* pass 1: the nearest clusters until they hold ``k + 1`` vectors give an
  exact top-k among their members and its k-th score ``s_k``;
* pass 2: every other cluster whose bound reaches ``s_k`` is searched;
* the top-k of both passes is the exact top-k (score rounded to 9
  digits, ties on the smaller id), because no vector of a skipped cluster
  can reach ``s_k``.

If pass 1 finds fewer than ``k`` candidates, pass 2 searches every
cluster.  Centre distances, radii and bounds are numpy batches.  In pass 1
scoring is a matrix product per block: the members of a cluster
are cut into blocks of about ``block`` vectors and the sources probing
it into blocks of about ``block`` sources, so no group grows with the
data, however uneven the clusters are.  Each block returns only its
local top-k per source.

Nothing is copied for a cluster that pass 2 visits: sources and members are
dealt once into packs of some blocks, members by cluster, and every pack of
sources meets every pack of members in a product of two stored tables.  A task
works out which clusters its sources must visit, and a product in single
precision rules out what cannot reach a source's k-th score; only the rest is
scored exactly.  The packs of members come in rounds, each ``GROWTH`` times as
many as all before; the k-th score so far is the floor of the next round, and
within a task that of what follows, so that a round leaves ``k`` rows a source.

There are about ``sqrt(n)`` clusters for ``n`` vectors, at any size: the
centres (``sqrt(n) x dim`` numbers) travel with the batch function, and as
many rows of cluster statistics reach the driver.  A source's distances and
bounds exist only inside a batch, a bounded number at a time; what leaves
pass 1's are the clusters that the source meets first.  Centres are fitted on a
bounded sample (``SAMPLE_PER_CLUSTER`` vectors a cluster, by a hash of the
id); which centres they are changes the work, never the result.  What
several steps read is written to the shared folder once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readpaths.operators.neighbors import top_k
from readpaths.session import removed, stored

DEFAULT_K = 100
SAMPLE_PER_CLUSTER = 64
BLOCK = 2048          # vectors (and sources) per scoring block
CELLS = 1 << 20       # source x centre distances held at a time
BOUND_SLACK = 1e-7    # covers the 9-digit rounding of scores and float error of the bound
PACK_BLOCKS = 8       # blocks of a pack
PACK_VALUES = 1 << 20  # components in a pack, at most
MAX_FILES = 1000      # of a table of packs
GROWTH = 2            # packs of members of a round, in units of all before
FEW = 16              # up to that share of the pairs of a block is scored one by one
SCORE_SCHEMA = "src long, nn long, score double"


def unit_vectors(vectors: DataFrame, id_col: str = "page_id", vec_col: str = "vector") -> DataFrame:
    """``page_id, u``: vectors scaled to length 1 as array<double> (zero vectors dropped)."""
    feats = vectors.select(F.col(id_col).alias("page_id"), array_to_vector(vec_col).alias("_v"))
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(feats)
    u = vector_to_array("_u")
    return unit.select("page_id", u.alias("u")).where(F.exists("u", lambda x: x != 0))


def _block_top_k(k: int):
    """Per block: all source x member cosines, rounded, local top-k per source, none below the source's ``floor`` if it has one."""

    def score(_key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"src": pd.Series([], dtype="int64"), "nn": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        qs = q["src"].to_numpy(np.int64)
        ms = m["nn"].to_numpy(np.int64)
        s = np.round(np.stack(q["u_src"].to_numpy()) @ np.stack(m["u_nn"].to_numpy()).T, 9)
        s[qs[:, None] == ms[None, :]] = -np.inf
        if "floor" in q:
            s[s < q["floor"].to_numpy()[:, None]] = -np.inf
        out_src, out_nn, out_s = [], [], []
        kk = min(k, len(ms))
        for i in range(len(qs)):
            row = s[i]
            live = np.flatnonzero(np.isfinite(row))
            # order: score descending, then member id ascending
            idx = live[np.lexsort((ms[live], -row[live]))[:kk]]
            out_src.append(np.full(len(idx), qs[i], np.int64))
            out_nn.append(ms[idx])
            out_s.append(row[idx])
        return pd.DataFrame({"src": np.concatenate(out_src), "nn": np.concatenate(out_nn),
                             "score": np.concatenate(out_s)})

    return score


def _cluster_sizes(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("c").agg(F.count(F.lit(1)).alias(name))


def blocked_candidates(probe: DataFrame, members: DataFrame, sizes: DataFrame, k: int, block: int) -> DataFrame:
    """Score every (source, member) pair of the probed clusters in bounded blocks.

    ``probe``: ``src, u_src, c`` and, where only scores from it on count,
    ``floor``; ``members``: ``nn, u_nn, c``; ``sizes``:
    ``c, members``.  The numbers of blocks are a stored table of one row per
    probed cluster; members of other clusters stay behind in its join.
    """
    blocks_of = lambda n: F.ceil(F.col(n) / block).cast("long")
    grid = stored(_cluster_sizes(probe, "sources").join(sizes, "c")
                  .select("c", blocks_of("members").alias("nmb"), blocks_of("sources").alias("nqb")), "grid")
    # all three keys are bigint on both sides: keys of different types hash to different partitions
    zero, one, cluster = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("c").cast("long")
    # members: own block by id hash, copied to every source block of the cluster
    mm = (members.join(grid, "c").withColumn("mb", F.pmod(F.xxhash64("nn"), "nmb"))
          .withColumn("qb", F.explode(F.sequence(zero, F.col("nqb") - one))).withColumn("c", cluster))
    qq = (probe.join(grid, "c").withColumn("qb", F.pmod(F.xxhash64("src"), "nqb"))
          .withColumn("mb", F.explode(F.sequence(zero, F.col("nmb") - one))).withColumn("c", cluster))
    asked = ["src", "u_src", *(["floor"] if "floor" in probe.columns else [])]
    return (qq.select("c", "mb", "qb", *asked).groupBy("c", "mb", "qb")
            .cogroup(mm.select("c", "mb", "qb", "nn", "u_nn").groupBy("c", "mb", "qb"))
            .applyInPandas(_block_top_k(k), SCORE_SCHEMA))


def _radius_fn(centers: np.ndarray):
    """Per batch of members: distance to the centre of their own cluster."""

    def run(batches):
        for b in batches:
            if b.empty:
                yield b.assign(_r=pd.Series([], dtype="float64"))
                continue
            u = np.stack(b["u"].to_numpy())
            m = centers[b["c"].to_numpy()]
            yield b.assign(_r=np.sqrt(((u - m) ** 2).sum(axis=1)))

    return run


def _distances(u: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of every row of ``u`` to every centre."""
    squares = (u ** 2).sum(axis=1)[:, None] + (centers ** 2).sum(axis=1)[None, :] - 2.0 * u @ centers.T
    return np.sqrt(np.maximum(0.0, squares))


def _slices(batches, n_clusters: int, cells: int):
    """The batches in slices whose distances to all centres stay within ``cells``."""
    step = max(1, cells // n_clusters)
    for b in batches:
        for at in range(0, len(b), step):
            yield b.iloc[at:at + step]


def _first_fn(centers: np.ndarray, size: np.ndarray, k: int):
    """Per batch of sources: the clusters of pass 1, nearest centre first until they hold ``k + 1`` vectors."""

    def run(batches):
        for b in _slices(batches, len(centers), CELLS):
            order = np.argsort(_distances(np.stack(b["u"].to_numpy()), centers), axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            # clusters taken: all before the first point where k + 1 vectors are held, and that one
            n_take = np.minimum((held < k + 1).sum(axis=1) + 1, len(centers))
            first = [order[i, :n].astype(np.int32) for i, n in enumerate(n_take)]
            yield pd.DataFrame({"src": b["page_id"].to_numpy(), "u_src": b["u"].to_numpy(), "first": first})

    return run


def pack_size(block: int, dim: int) -> int:
    """Vectors of a pack."""
    return max(1, min(block * PACK_BLOCKS, PACK_VALUES // max(1, dim)))


def pack_of(id_col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(n))


def may_reach(a: np.ndarray, b: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of unit vectors ``a`` and ``b`` (single precision) whose product may reach the floor of ``a``; None if they are not few."""
    product = a @ b.T
    least = (floor - (1e-6 + 2.5e-7 * a.shape[1])).astype(np.float32)  # at most dim roundings of terms whose sizes add up to 1
    rows = np.flatnonzero(product.max(axis=1) >= least)
    live = product[rows] >= least[rows, None]
    if np.count_nonzero(live) * FEW > product.size:
        return None
    i, j = np.nonzero(live)
    return rows[i], j


def pair_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    step = max(1, CELLS // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        out[at:at + step] = np.einsum("ij,ij->i", a[i[at:at + step]], b[j[at:at + step]])
    return out


class Best:
    """The best ``k`` of every source of a pack so far; ``floor`` rises to the k-th score."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.new, self.waiting = floor, k, [], 0

    def add(self, i: np.ndarray, nn: np.ndarray, score: np.ndarray) -> None:
        if len(i):
            self.new.append((i, nn, score))
            self.waiting += len(i)
        if self.waiting > self.k * len(self.floor) // 2:
            self.settle()

    def settle(self) -> None:
        """Leave the best of what was added, and raise the floors."""
        if not self.waiting:
            return
        i, nn, score = (np.concatenate(x) for x in zip(*self.new, strict=True))
        order = np.lexsort((nn, -score, i))
        order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < self.k]
        i, nn, score = i[order], nn[order], score[order]
        last = np.flatnonzero(np.append(i[1:] != i[:-1], True))
        last = last[np.bincount(i, minlength=len(self.floor))[i[last]] == self.k]
        self.floor[i[last]] = np.maximum(self.floor[i[last]], score[last])
        self.new, self.waiting = [(i, nn, score)], 0

    def rows(self, ids: np.ndarray):
        self.settle()
        for i, nn, score in self.new:
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(nn), pa.array(score)], names=["src", "nn", "score"])


def floors_of(ids: np.ndarray, asked: np.ndarray | None, floors: np.ndarray | None) -> np.ndarray:
    """The floor of each id, that of ``asked`` or none."""
    if asked is None or not len(asked):
        return np.full(len(ids), -2.0)
    order = np.argsort(asked)
    at = order[np.minimum(np.searchsorted(asked[order], ids), len(asked) - 1)]
    return np.where(asked[at] == ids, floors[at], -2.0)


def in_rounds(packs: DataFrame, n_sources: int, held: DataFrame, n_members: int, search, k: int, best: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """``src, nn, score``: ``best`` and what ``search`` finds for ``packs`` of sources (``pack`` as in ``pack_of``) among those of members (``at`` below ``n_members``)."""
    first = 0
    while first < n_members:
        then = max(1, (1 + GROWTH) * first)
        if best is None:
            sources = packs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("asked", "array<long>"), ("floors", "array<double>"))))
        else:
            least = best.groupBy("src").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            floors = least.groupBy(pack_of("src", n_sources).alias("pack")).agg(F.collect_list(F.struct("src", "floor")).alias("f"))
            sources = stored(packs.join(floors, "pack", "left").select(*packs.columns, F.col("f.src").alias("asked"), F.col("f.floor").alias("floors"))
                             .repartition(min(n_sources, MAX_FILES), "pack"), "asking-packs")
        met = sources.crossJoin(held.where((F.col("at") >= first) & (F.col("at") < then)).drop("at").hint("shuffle_replicate_nl"))
        new = met.mapInArrow(search, SCORE_SCHEMA)
        every = new if best is None else best.union(new)
        if distinct:
            every = every.repartition("src").distinct()
        done = stored(top_k(every, "src", "score", "nn", k).drop("rank"), "best")
        if best is not None:
            removed(best)
            removed(sources)
        best, first = done, then
    removed(packs)
    return best


def _pack_sources(group: pd.DataFrame) -> pd.DataFrame:
    """A pack's ids, vectors and (place of the source, cluster of pass 1), as bytes."""
    first = group["first"].to_numpy()
    place = np.repeat(np.arange(len(first)), [len(x) for x in first])
    return pd.DataFrame({"pack": [group["pack"].iloc[0]], "ids": [group["src"].to_numpy(np.int64).tobytes()], "u": [np.stack(group["u_src"].to_numpy()).astype(np.float64).tobytes()],
                         "place": [place.astype(np.int64).tobytes()], "met": [np.concatenate(first).astype(np.int32).tobytes()]})


def _pack_members(group: pd.DataFrame) -> pd.DataFrame:
    """A pack's ids, vectors and clusters, by cluster, as bytes."""
    group = group.sort_values(["c", "nn"], kind="stable")
    return pd.DataFrame({"at": [group["at"].iloc[0]], "member_ids": [group["nn"].to_numpy(np.int64).tobytes()],
                         "member_u": [np.stack(group["u_nn"].to_numpy()).astype(np.float64).tobytes()], "member_c": [group["c"].to_numpy(np.int32).tobytes()]})


def _second_fn(centers: np.ndarray, radius: np.ndarray, k: int, block: int):
    """Per row, a pack of sources beside a pack of members: each source's best ``k`` in the further clusters that can still reach its floor.

    The bound of cluster ``c`` is ``1 - max(0, |q - m_c| - r_c)^2 / 2``.  A
    source's bounds exist for a block of members at a time.
    """

    def run(batches):
        held = best = None
        for b in batches:
            for n in range(b.num_rows):
                cell = {c: b.column(c)[n] for c in b.schema.names}
                if cell["pack"].as_py() != held:
                    if best is not None:
                        yield from best.rows(ids)
                    held, ids = cell["pack"].as_py(), np.frombuffer(cell["ids"].as_py(), np.int64)
                    u = np.frombuffer(cell["u"].as_py(), np.float64).reshape(len(ids), -1)
                    short, place, met = u.astype(np.float32), np.frombuffer(cell["place"].as_py(), np.int64), np.frombuffer(cell["met"].as_py(), np.int32)
                    best = Best(floors_of(ids, *(None if cell[c].values is None else cell[c].values.to_numpy() for c in ("asked", "floors"))), k)
                every, clusters = np.frombuffer(cell["member_ids"].as_py(), np.int64), np.frombuffer(cell["member_c"].as_py(), np.int32)
                vectors = np.frombuffer(cell["member_u"].as_py(), np.float64).reshape(len(every), -1)
                for m in range(0, len(every), block):
                    nn, members, (own, c) = every[m:m + block], vectors[m:m + block], np.unique(clusters[m:m + block], return_inverse=True)
                    for i, j, score in _further(u, short, ids, best.floor, (place, met), members, nn, c, own, centers[own], radius[own], k):
                        best.add(i, nn[j], score)
        if best is not None:
            yield from best.rows(ids)

    return run


def _further(u, short, ids, floor, first, members, nn, c, clusters, centers, radius, k):
    """Pairs (source, member) of clusters that the source must visit and did not at first, none below its floor, and scores."""
    place, met = first
    at = np.minimum(np.searchsorted(clusters, met), len(clusters) - 1)
    mine = clusters[at] == met
    place, at = place[mine], at[mine]  # places are in ascending order
    single, step = members.astype(np.float32), max(1, CELLS // max(len(nn), len(clusters)))
    for low in range(0, len(ids), step):
        rows = slice(low, low + step)
        far = np.maximum(0.0, _distances(u[rows], centers) - radius)
        visit = 1.0 - far ** 2 / 2.0 >= floor[rows, None] - BOUND_SLACK
        here = slice(*np.searchsorted(place, (low, low + step)))
        visit[place[here] - low, at[here]] = False
        which = np.flatnonzero(visit.any(axis=1))
        if not len(which):
            continue
        visit, which = visit[which], which + low
        pairs = may_reach(short[which], single, floor[which])
        if pairs is not None:
            i, j = pairs
            good = visit[i, c[j]] & (ids[which[i]] != nn[j])
            i, j = i[good], j[good]
            score = np.round(pair_scores(u[which], members, i, j), 9)
        else:
            every = np.round(u[which] @ members.T, 9)
            every[~visit[:, c] | (ids[which][:, None] == nn)] = -np.inf
            if k < len(nn):
                every[every < np.partition(every, -k, axis=1)[:, -k, None]] = -np.inf
            i, j = np.nonzero(np.isfinite(every))
            score = every[i, j]
        good = score >= floor[which[i]]
        yield which[i[good]], j[good], score[good]


def vector_neighbors(vectors: DataFrame, k: int = DEFAULT_K, sources: DataFrame | None = None,
                     id_col: str = "page_id", vec_col: str = "vector", n_clusters: int | None = None,
                     block: int = BLOCK, seed: int = 1, max_iter: int = 5) -> DataFrame:
    """Top-``k`` vectors by cosine for each source: ``src, nn, score, rank``.

    ``sources`` (first column = id) restricts the sources; default is every
    vector.  The source itself is never its own neighbour.
    """
    units = stored(unit_vectors(vectors, id_col, vec_col), "units")
    n_rows = units.count()
    if n_rows == 0:
        return vectors.sparkSession.createDataFrame([], "src long, nn long, score double, rank int")
    n_clusters = int(max(1, min(n_rows, n_clusters or math.isqrt(n_rows))))
    share = F.pmod(F.xxhash64("page_id"), F.lit(n_rows)) < SAMPLE_PER_CLUSTER * n_clusters
    sample = units.where(share).select(array_to_vector("u").alias("_f"))
    if n_clusters > 1:
        model = KMeans(k=n_clusters, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="c").fit(sample)
        cmat = np.asarray(model.clusterCenters(), dtype=np.float64)
        assigned = model.transform(units.withColumn("_f", array_to_vector("u"))).select("page_id", "u", F.col("c").cast("int").alias("c"))
    else:
        cmat = np.zeros((1, len(units.first()["u"])))
        assigned = units.withColumn("c", F.lit(0))
    n_c = len(cmat)
    members = stored(assigned.mapInPandas(_radius_fn(cmat), "page_id long, u array<double>, c int, _r double"), "members")
    stats = stored(members.groupBy("c").agg(F.max("_r").alias("radius"), F.count(F.lit(1)).alias("members")), "clusters")
    sizes = stats.select("c", "members")
    members = members.select(F.col("page_id").alias("nn"), F.col("u").alias("u_nn"), "c")

    radius, size = np.zeros(n_c), np.zeros(n_c, dtype=np.int64)
    for r in stats.collect():  # one row per cluster, as many as there are centres
        radius[r["c"]], size[r["c"]] = r["radius"], r["members"]
    queries = units if sources is None else units.join(
        sources.select(F.col(sources.columns[0]).alias("page_id")).distinct(), "page_id", "left_semi")
    q = stored(queries.select("page_id", "u").mapInPandas(_first_fn(cmat, size, k), "src long, u_src array<double>, first array<int>"), "probes")

    first = blocked_candidates(q.select("src", "u_src", F.explode("first").alias("c")), members, sizes, k, block)
    first_top = stored(top_k(first, "src", "score", "nn", k), "first")
    removed(units)

    dim = cmat.shape[1]
    size_of = pack_size(block, dim)
    n_sources, places, n_packs, room = max(1, -(-q.count() // size_of)), [], 0, 0
    for c in range(n_c):  # clusters beside each other in a pack, a large one in several
        subs = max(1, -(-int(size[c]) // size_of))
        if subs > 1 or size[c] > room:
            n_packs, room = n_packs + subs, size_of if subs == 1 else 0
        places.append((c, n_packs - subs, subs))
        room -= size[c] if subs == 1 else 0
    places = vectors.sparkSession.createDataFrame(places, "c int, first long, subs int")
    dealt = members.join(places, "c").select((F.col("first") + F.pmod(F.xxhash64("nn"), "subs")).alias("at"), "nn", "u_nn", "c")
    held = stored(dealt.repartition(min(n_packs, MAX_FILES), "at").groupBy("at").applyInPandas(_pack_members, "at long, member_ids binary, member_u binary, member_c binary"), "member-packs")
    asking = q.select(pack_of("src", n_sources).alias("pack"), "src", "u_src", "first").repartition(min(n_sources, MAX_FILES), "pack")
    packs = stored(asking.groupBy("pack").applyInPandas(_pack_sources, "pack long, ids binary, u binary, place binary, met binary"), "source-packs")
    both = in_rounds(packs, n_sources, held, n_packs, _second_fn(cmat, radius, k, block), k, first_top.select("src", "nn", "score"))
    return top_k(both, "src", "score", "nn", k).select("src", "nn", "score", "rank")
