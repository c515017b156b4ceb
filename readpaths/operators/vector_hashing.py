"""Cosine top-k by multi-probe random-projection tables (K8 beyond exact search).

Each of ``tables`` hash tables puts a unit vector into the bucket named by the
signs of its products with ``bits`` random planes.  A source visits its own
bucket and those whose signs differ where its products are nearest to zero, the
cheapest changes first (sum of the squared products that change sign).  How
many buckets it visits is not guessed: ``tuned`` compares ``SAMPLE`` sources
with every vector, finds for each of their true neighbours the probe that would
meet it, and takes the fewest probes that reach the wanted recall.  Where even
all changes of the ``WEAK`` weakest signs do not, the tables get two bits fewer;
with none left the search is exact.

* Equal vectors are one member: of a group of copies only the ``k + 1``
  smallest ids can be anybody's neighbours, and they come back at the end.
* Nothing is copied for a visit: members and sources are dealt once into packs
  of about ``block`` vectors, and every pack of sources meets every pack of
  members in a product of two stored tables.  A task that holds both works out
  the buckets and scores only pairs that meet in a table.
* The packs of members come in rounds, each ``vectors.GROWTH`` times as many as
  all before.  A source keeps its best ``k`` so far; their last score is the
  floor of the next round and, within a task, of the blocks that follow, so
  that a round returns few rows a source, however many buckets it visits.  A
  product in single precision rules out what cannot reach the floor; only the
  rest is scored exactly.  What a round leaves on disk replaces that of the round
  before; the number of rounds is logarithmic in that of the packs.

Null and zero vectors take no part; an empty table gives an empty result; an
id has one row, as in the exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readpaths.operators.neighbors import top_k
from readpaths.operators.vectors import BLOCK, CELLS, DEFAULT_K, MAX_FILES, Best, floors_of, in_rounds, may_reach, pack_of, pack_size, pair_scores, unit_vectors
from readpaths.session import stored

TABLES = 8
BUCKET = 2048   # vectors per bucket, on average
RECALL = 0.95   # on the sample
SAMPLE = 200    # sources that are compared with every vector
WEAK = 10       # signs of a table that probes may change
MAX_BITS = 30
LOOKUP = 16  # looking a bucket up costs as much as comparing with so many members


@dataclass(frozen=True)
class Search:
    """Tuned tables: ``planes`` (tables x dimensions x bits), buckets visited in a table, recall on the sample."""

    planes: np.ndarray
    probes: int
    recall: float

    @property
    def bits(self) -> int:
        return self.planes.shape[2]


def _planes(tables: int, dim: int, bits: int, seed: int) -> np.ndarray:
    """With no bits one table holds everything."""
    return np.random.default_rng(seed).standard_normal((tables if bits else 1, dim, bits))


def _codes(products: np.ndarray) -> np.ndarray:
    return (products > 0) @ (1 << np.arange(products.shape[1], dtype=np.int64))


def _changes(weak: int) -> np.ndarray:
    """All subsets of the weak signs, a row each."""
    return (np.arange(1 << weak)[:, None] >> np.arange(weak)) & 1


def _probe_codes(products: np.ndarray, probes: int) -> np.ndarray:
    """The buckets of one table that each row visits, its own first."""
    weak = min(WEAK, products.shape[1])
    near = np.argsort(np.abs(products), axis=1, kind="stable")[:, :weak]
    subsets = _changes(weak)
    cost = np.take_along_axis(products, near, axis=1) ** 2 @ subsets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return _codes(products)[:, None] ^ (subsets[best] * (1 << near)[:, None, :]).sum(axis=2)


def _meeting_probe(sources: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Source x member: the number of cheaper probes of one table before the one that meets, ``2^WEAK`` if none does."""
    bits = sources.shape[1]
    weak = min(WEAK, bits)
    out = np.empty((len(sources), len(members)), np.int64)
    subsets, signs = _changes(weak), members > 0
    for i, s in enumerate(sources):
        near = np.argsort(np.abs(s), kind="stable")
        cost = np.sort(s[near[:weak]] ** 2 @ subsets.T)
        differ = signs[:, near] != (s[near] > 0)
        at = np.searchsorted(cost, differ[:, :weak] @ s[near[:weak]] ** 2 * (1 + 1e-12), side="right") - 1
        out[i] = np.where(differ[:, weak:].any(axis=1), 1 << WEAK, np.maximum(at, 0))
    return out


def _slices(batches, step: int):
    for b in batches:
        for at in range(0, len(b), step):
            yield b.iloc[at:at + step]


def _truth_fn(ids: np.ndarray, sample: np.ndarray, planes: np.ndarray, k: int):
    """Per batch of vectors: each sample source's best ``k`` of them, and the probe that would meet each."""
    def run(batches):
        for b in _slices(batches, max(1, CELLS // len(sample))):
            u, nn = np.stack(b["u"].to_numpy()), b["page_id"].to_numpy()
            score = np.round(sample @ u.T, 9)
            score[ids[:, None] == nn[None, :]] = -np.inf
            for i in range(len(sample)):
                best = np.lexsort((nn, -score[i]))[:k]
                best = best[np.isfinite(score[i][best])]
                if len(best):
                    at = np.min([_meeting_probe(sample[i:i + 1] @ p, u[best] @ p)[0] for p in planes], axis=0)
                    yield pd.DataFrame({"src": ids[i], "nn": nn[best], "score": score[i][best], "at": at})

    return run


def tuned(members: DataFrame, k: int = DEFAULT_K, recall: float = RECALL, tables: int = TABLES, bucket: int = BUCKET, seed: int = 1) -> Search | None:
    """Tables over ``members`` (``page_id, u``, distinct unit vectors); None for an empty table."""
    n = members.count()
    sample = members.orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(SAMPLE).collect()
    if not sample:
        return None
    ids, u = np.array([r["page_id"] for r in sample]), np.array([r["u"] for r in sample])
    bits = min(MAX_BITS, max(0, round(math.log2(n / bucket))))
    while True:
        planes = _planes(tables, u.shape[1], bits, seed)
        if not bits:
            return Search(planes, 1, 1.0)
        truth = top_k(members.mapInPandas(_truth_fn(ids, u, planes, k), "src long, nn long, score double, at long"), "src", "score", "nn", k)
        met = np.zeros((1 << WEAK) + 1, np.int64)
        for r in truth.groupBy("at").count().collect():  # a row per number of probes, 2^WEAK + 1 at most
            met[r["at"]] = r["count"]
        reached = np.cumsum(met)[:-1] / max(1, met.sum())
        if not met.sum() or reached[-1] >= recall:
            probes = int(np.argmax(reached >= recall)) + 1
            return Search(planes, min(probes, 1 << min(WEAK, bits)), float(reached[probes - 1]))
        bits = max(0, bits - 2)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """A pack's ids in ascending order and their vectors, as bytes."""
    group = group.sort_values("id")
    return pd.DataFrame({"pack": [group["pack"].iloc[0]], "ids": [group["id"].to_numpy(np.int64).tobytes()],
                         "u": [np.stack(group["u"].to_numpy()).astype(np.float64).tobytes()]})


def _packs(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``page_id, u`` as ``n`` packs, each a row ``pack, ids, u``."""
    dealt = rows.select(pack_of("page_id", n).alias("pack"), F.col("page_id").alias("id"), "u")
    return stored(dealt.repartition(min(n, MAX_FILES), "pack").groupBy("pack").applyInPandas(_pack, "pack long, ids binary, u binary"), name)


def _unpacked(ids: bytes, u: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(u, np.float64).reshape(len(ids), -1)


class _Sources:
    """A pack of sources: ids, vectors, floors, and per table either the visited buckets or what a changed sign costs."""

    def __init__(self, search: Search, ids: bytes, u: bytes, asked: np.ndarray | None, floors: np.ndarray | None):
        self.search = search
        self.ids, self.u = _unpacked(ids, u)
        self.short = self.u.astype(np.float32)
        self.floor = floors_of(self.ids, asked, floors)
        self.products = [self.u @ p for p in search.planes]
        self.visits = self.costs = None

    def codes(self) -> list[np.ndarray]:
        """Source x visited bucket, per table."""
        if self.visits is None:
            step = max(1, CELLS >> min(WEAK, self.search.bits))
            self.visits = [np.concatenate([_probe_codes(x[at:at + step], self.search.probes) for at in range(0, len(x), step)]) for x in self.products]
        return self.visits

    def weights(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table: the cost of a member's 0 and 1 in each place, and that of the last visited bucket."""
        if self.costs is None:
            self.costs = [_weights(x, self.search.probes) for x in self.products]
        return self.costs


def _weights(products: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    weak = min(WEAK, products.shape[1])
    near = np.argsort(np.abs(products), axis=1, kind="stable")[:, :weak]
    squares = np.take_along_axis(products, near, axis=1) ** 2
    cost = np.full(products.shape, 1e30)  # a sign that no probe changes
    np.put_along_axis(cost, near, squares, axis=1)
    last = np.empty(len(products))
    step = max(1, CELLS >> weak)
    for at in range(0, len(products), step):
        last[at:at + step] = np.partition(squares[at:at + step] @ _changes(weak).T, probes - 1, axis=1)[:, probes - 1]
    one = products > 0
    return np.hstack((cost * one, cost * ~one)), last * (1 + 1e-12)


def _looked_up(codes: list[np.ndarray], tables: list[np.ndarray], rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (source, member) that meet, by looking the visited buckets up."""
    met = []
    for visits, own in zip(codes, tables, strict=True):
        order = np.argsort(own, kind="stable")
        visits = visits[rows]
        low = np.searchsorted(own[order], visits.ravel(), side="left")
        n = np.searchsorted(own[order], visits.ravel(), side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met.append(np.repeat(np.arange(len(visits)), visits.shape[1]).repeat(n) * len(own) + order[at])
    pairs = np.unique(np.concatenate(met))
    return pairs // len(tables[0]), pairs % len(tables[0])


def _met(s: _Sources, signs: list[np.ndarray], u: np.ndarray, ids: np.ndarray, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the sources ``rows`` with members that share a visited bucket, none below the source's floor, and scores."""
    search, floor, own = s.search, s.floor[rows], s.ids[rows]
    if search.bits and len(search.planes) * search.probes * LOOKUP < len(ids):
        i, j = _looked_up(s.codes(), [_codes(x - 0.5) for x in signs], rows)
        score = np.round(pair_scores(s.u[rows], u, i, j), 9)
        good = (score >= floor[i]) & (own[i] != ids[j])
        return i[good], j[good], score[good]
    pairs = may_reach(s.short[rows], u.astype(np.float32), floor)
    if pairs is None:
        score = np.round(s.u[rows] @ u.T, 9)
        meets = np.zeros(score.shape, bool)
        for (cost, last), x in zip(s.weights(), signs, strict=True):
            meets |= cost[rows] @ np.hstack((1.0 - x, x)).T <= last[rows, None]
        score[~(meets & (score >= floor[:, None])) | (own[:, None] == ids[None, :])] = -np.inf
        if k < len(ids):
            score[score < np.partition(score, -k, axis=1)[:, -k, None]] = -np.inf
        i, j = np.nonzero(np.isfinite(score))
        return i, j, score[i, j]
    i, j = pairs
    score = np.round(pair_scores(s.u[rows], u, i, j), 9)
    good = (score >= floor[i]) & (own[i] != ids[j])
    i, j, score = i[good], j[good], score[good]
    some, at = np.unique(j, return_inverse=True)
    meets = np.zeros(len(i), bool)
    for (cost, last), x in zip(s.weights(), signs, strict=True):
        meets |= pair_scores(cost[rows], np.hstack((1.0 - x[some], x[some])), i, at) <= last[rows][i]
    return i[meets], j[meets], score[meets]


def _product_fn(search: Search, k: int, block: int):
    """Per row, a pack of sources beside a pack of members: each source's best ``k`` of the members that it meets in a task."""
    def run(batches):
        held = s = best = None
        for b in batches:
            for n in range(b.num_rows):
                cell = {c: b.column(c)[n] for c in b.schema.names}
                if cell["pack"].as_py() != held:
                    if best is not None:
                        yield from best.rows(s.ids)
                    floors = [None if cell[c].values is None else cell[c].values.to_numpy() for c in ("asked", "floors")]
                    held, s = cell["pack"].as_py(), _Sources(search, cell["ids"].as_py(), cell["u"].as_py(), *floors)
                    best = Best(s.floor, k)
                every, vectors = _unpacked(cell["member_ids"].as_py(), cell["member_u"].as_py())
                for m in range(0, len(every), block):
                    ids, u = every[m:m + block], vectors[m:m + block]
                    signs = [(u @ p > 0).astype(np.float64) for p in search.planes]
                    step = max(1, CELLS // len(ids))
                    for at in range(0, len(s.ids), step):
                        i, j, score = _met(s, signs, u, ids, slice(at, at + step), k)
                        best.add(i + at, ids[j], score)
        if best is not None:
            yield from best.rows(s.ids)

    return run


def _searched(asking: DataFrame, members: DataFrame, search: Search, k: int, block: int) -> DataFrame:
    """``src, nn, score``: each source's best ``k`` of the members that it meets in a visited bucket."""
    size = pack_size(block, search.planes.shape[1])
    n_members, n_sources = (max(1, math.ceil(x.count() / size)) for x in (members, asking))
    held = _packs(members, n_members, "member-packs").select(F.col("pack").alias("at"), F.col("ids").alias("member_ids"), F.col("u").alias("member_u"))
    return in_rounds(_packs(asking, n_sources, "source-packs"), n_sources, held, n_members, _product_fn(search, k, block), k, distinct=True)


def vector_neighbors_hashed(vectors: DataFrame, k: int = DEFAULT_K, sources: DataFrame | None = None, id_col: str = "page_id",
                            vec_col: str = "vector", recall: float = RECALL, tables: int = TABLES, bucket: int = BUCKET,
                            block: int = BLOCK, seed: int = 1) -> DataFrame:
    """Top-``k`` vectors by cosine found for each source: ``src, nn, score, rank``.

    Scores are exact; ``recall`` is the share of true neighbours found, as
    tuned on the sample.  ``sources`` (first column = id) restricts the sources.
    """
    units = stored(unit_vectors(vectors.where(F.col(vec_col).isNotNull()), id_col, vec_col), "units")
    copies = stored(units.withColumn("copy", F.row_number().over(Window.partitionBy("u").orderBy("page_id"))).where(F.col("copy") <= k + 1), "copies")
    members = stored(copies.where("copy = 1").select("page_id", "u"), "members")
    search = tuned(members, k, recall, tables, bucket, seed)
    if search is None:
        return vectors.sparkSession.createDataFrame([], "src long, nn long, score double, rank int")
    class_of = lambda rows: rows.join(members.withColumnRenamed("page_id", "class"), "u").drop("u")
    asked = units if sources is None else units.join(
        sources.select(F.col(sources.columns[0]).alias("page_id")).distinct(), "page_id", "left_semi")
    asking = stored(class_of(asked.select(F.col("page_id").alias("src"), "u")), "sources")
    asking_classes = stored(members.join(asking.select(F.col("class").alias("page_id")).distinct(), "page_id", "left_semi"), "asking")

    classes = _searched(asking_classes, members, search, k, block).select(F.col("src").alias("class"), F.col("nn").alias("found"), "score")
    own = asking_classes.select(F.col("page_id").alias("class"), F.col("page_id").alias("found"),
                                F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 9).alias("score"))
    ids = class_of(copies.select(F.col("page_id").alias("nn"), "u")).withColumnRenamed("class", "found")
    lists = top_k(classes.union(own).join(ids, "found"), "class", "score", "nn", k + 1).select("class", "nn", "score")
    pairs = asking.join(lists, "class").where("src != nn")
    return top_k(pairs, "src", "score", "nn", k).select("src", "nn", "score", "rank")
