"""Nearest neighbours by inner product with a vantage-point tree per shard.

Largest inner product becomes smallest Euclidean distance by one more
coordinate: rows get ``sqrt(M^2 - |x|^2)`` (M is the largest norm of the
tree), queries get 0 and the norm M.  Rows of very different size (by their
largest component, in steps of 2^8) go to trees of their own, as one giant
would make all others look equally far away.  In that metric space the rows of a
shard form a vantage-point tree: a node splits its rows at the median
distance to a vantage point and keeps the distance interval of either half,
and the triangle inequality bounds how near a half can be to a query.

A leaf is skipped when ``factor`` times its bound exceeds the distance of the
k-th neighbour found so far.  Factor 1 skips only what cannot matter (exact
search); larger factors skip more and may miss neighbours.

Rows are dealt to shards by a hash of the id, so equal vectors spread out; a
shard has one tree for each size of rows; every shard answers every block of queries, and the k best of all shards are
merged.  Every row is indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without id; vectors are compared with
queries of their own length only; a repeated id is one query (with the
smallest of its vectors) and never its own neighbour; other repeated rows are
neighbours as often as they occur; ties go to the smaller id; fewer than k
rows are all returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from readpaths.llm.shared import bounded_batches, stored

K = 20
FACTOR = 1.1
LEAF_ROWS = 64
SHARD_ROWS = 16_384
QUERY_ROWS = 4096
FIRST_LEAVES = 3
SLACK = 1e-6  # of the largest norm: rounding errors of distances near zero are roots of those of their squares


class Tree:
    """Rows in leaf order, leaves, and the splits above them (parents before children)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: float, leaf_rows: int = LEAF_ROWS, unit: float = 1.0):
        """``largest`` is the largest norm in units of ``unit``, in which distances are measured, so that no square overflows."""
        self.largest, self.unit = largest, unit
        scaled = rows / unit
        norms = np.einsum("ij,ij->i", scaled, scaled)
        lifted = np.concatenate((scaled, np.sqrt(np.maximum(largest**2 - norms, 0))[:, None]), axis=1)
        order = np.arange(len(ids))
        pending = [(0, len(ids), -1, 0.0, 0.0)]
        nodes, leaves, vantages = [], [], []  # node: (parent node, nearest, farthest of its rows to the parent's vantage point)
        while pending:
            a, b, parent, near, far = pending.pop()
            nodes.append((parent, near, far))
            if b - a <= leaf_rows:
                leaves.append((a, b, len(nodes) - 1))
                vantages.append(-1)
                continue
            own = order[a:b]
            # the row farthest from the first row spreads distances more than an inner one
            vantage = own[np.argmax(np.linalg.norm(lifted[own] - lifted[own[0]], axis=1))]
            distance = np.linalg.norm(lifted[own] - lifted[vantage], axis=1)
            by = np.argsort(distance, kind="stable")
            order[a:b], distance, middle = own[by], distance[by], (b - a) // 2
            vantages.append(vantage)
            for i, j in ((0, middle), (middle, b - a)):
                pending.append((a + i, a + j, len(nodes) - 1, distance[i], distance[j - 1]))
        self.ids, self.rows = ids[order], rows[order]
        self.parents = np.array([n[0] for n in nodes])
        self.near, self.far = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])
        self.leaves = np.array(leaves, dtype=np.int64).reshape(-1, 3)
        self.vantages = np.array(vantages)
        self.points = lifted[self.vantages[self.vantages >= 0]]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v for k, v in vars(self).items()})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        tree = Tree.__new__(Tree)
        with np.load(io.BytesIO(data)) as f:
            for k in f.files:
                setattr(tree, k, f[k])
        tree.largest, tree.unit = float(tree.largest), float(tree.unit)
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x leaves): how near a row of the leaf can be to the query (of norm ``largest``)."""
        lifted = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        squares = 2 * self.largest**2 - 2 * (lifted @ self.points.T)
        slot = np.cumsum(self.vantages >= 0) - 1
        distance = np.sqrt(np.maximum(squares, 0))
        least = np.zeros((len(self.parents), len(queries)))
        for node in range(1, len(self.parents)):
            parent = self.parents[node]
            d = distance[:, slot[parent]]
            least[node] = np.maximum(least[parent], np.maximum(d - self.far[node], self.near[node] - d))
        return least[self.leaves[:, 2]].T

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(queries x k) scores and ids, best first (-inf where there are fewer), and the number of leaf visits."""
        scaled = queries / np.abs(queries).max(axis=1, initial=0, keepdims=True)
        direction = scaled / np.einsum("ij,ij->i", scaled, scaled)[:, None] ** 0.5
        norm = np.einsum("ij,ij->i", direction, queries)
        bounds = self.bounds(direction * self.largest)
        best, found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        visits = 0

        def visit(leaf, who):
            nonlocal visits
            visits += len(who)
            a, b, _ = self.leaves[leaf]
            scores = np.einsum("ij,kj->ik", queries[who], self.rows[a:b])
            near = np.broadcast_to(self.ids[a:b], scores.shape)
            scores = np.where(near == ids[who, None], -np.inf, scores)
            all_scores, all_ids = np.concatenate((best[who], scores), axis=1), np.concatenate((found[who], near), axis=1)
            all_ids = np.where(np.isneginf(all_scores), np.iinfo(np.int64).max, all_ids)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[who], found[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

        ranked = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST_LEAVES]
        seen = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(seen, ranked, True, axis=1)
        for leaf in np.flatnonzero(seen.any(axis=0)):
            visit(leaf, np.flatnonzero(seen[:, leaf]))
        for leaf in np.argsort(bounds.min(axis=0), kind="stable"):
            # distance of the k-th neighbour so far; infinite while there are fewer
            worst = np.sqrt(np.maximum(2 * self.largest**2 - 2 * self.largest * (best[:, -1] / norm / self.unit), 0))
            # a bound that is no number (components beyond all range) skips nothing
            who = np.flatnonzero(~seen[:, leaf] & ~(factor * bounds[:, leaf] > worst + SLACK * self.largest))
            if len(who):
                visit(leaf, who)
        return best, found, visits


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR,
               query: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows found nearest to each query row.

    ``query`` picks the query rows (default: ids divisible by 20); candidates are all other rows.
    """
    bounded_batches(table.sparkSession)
    kept = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where(F.col("id").isNotNull() & usable(F.col("v")))
    shards = max(1, -(-kept.count() // shard_rows))
    dealt = kept.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def build(group: pa.Table) -> pa.Table:
        ids, rows = group.column("id").to_numpy(), _matrix(group.column("v"))
        most = np.abs(rows).max(axis=1)
        band, trees = (np.frexp(most)[1] + 4) // 8, []
        for b in np.unique(band):
            own, unit = rows[band == b], float(most[band == b].max())
            largest = float(np.sqrt(((own / unit) ** 2).sum(axis=1).max()) * (1 + 1e-12))
            trees.append(Tree(ids[band == b], own, largest, unit=unit).dump())
        return pa.table({"dim": pa.array([group.column("dim")[0].as_py()] * len(trees), pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()] * len(trees), pa.int32()),
                         "tree": pa.array(trees, pa.binary())})

    trees = stored(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "trees")
    asked = kept.where(F.col("id") % 20 == 0 if query is None else query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    cells = trees.select("dim", "shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if left.num_rows and right.num_rows:
            ids, queries = right.column("id").to_numpy(), _matrix(right.column("v"))
            for data in left.column("tree"):
                best, found, _ = Tree.load(data.as_py()).search(ids, queries, k, factor)
                good = np.isfinite(best)
                out.append(pa.table({"query_id": np.repeat(ids, good.sum(axis=1)), "vec_id": found[good], "score": best[good]}))
        return pa.concat_tables(out)

    keys = ("dim", "shard", "block")
    answers = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
