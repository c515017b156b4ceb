"""Hard negatives from a tree of multiway hyperplane splits with distance ranges (GNAT).

Scores are integer inner products.  They become distances by one more
coordinate: rows get ``sqrt(M^2 - |x|^2)`` (M is the largest norm), anchors get
0, so that ``d^2 = |q|^2 + M^2 - 2 * score`` and a window of scores is an
annulus around the anchor.

A node has up to ``SPLITS`` split points; a row goes to the nearest one, and
for every pair of a split point and a subtree the node keeps the range of
distances between the point and the subtree's rows.  With ``d`` the anchor's
distance to a split point, a row of the annulus ``[low, high]`` can only be at
a distance of ``[max(d - high, low - d), d + high]`` from that point; a
subtree whose range misses this for any split point is skipped.  Leaves are
scored exactly, in whole numbers, so nothing is lost.

The first level of the tree is spread over the cluster: its split points come
from a bounded sample (``ROOT_ROWS`` rows), every row goes to the nearest, and
the cells' ranges decide which anchors are sent to which cells.  A cell's rows
are dealt to shards of about ``SHARD_ROWS`` by a hash, so a cell of any size is
many tasks, and each shard is the rest of the tree.  Shards and the anchors
sent to them are sorted into one stream of rows, tree first: a task holds one
tree and one batch of anchors at a time.

Positives are searched as nearest rows of the anchor's label, first in the
anchor's own cell, then, with the distance of the last of these as bound, in
the other cells that can hold a nearer one.  Every positive's score then gives
a window, and the windows are searched among rows of other labels; the outer
radius shrinks to the last of the best rows found.

Cases: rows with a null id, label or vector, an empty vector, or any null or
non-finite component take no part; vectors are compared with those of their
own length only; an anchor's other rows are those of other ids, a repeated row
counts as often as it occurs, and a repeated anchor row gives its result as
often; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored.  A table whose scores can pass 2^62 raises, as they would
not fit the result's numbers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readpaths.llm.shared import bounded_batches, stored

SCALE = 256
SPLITS = 16
LEAF_ROWS = 128
SHARD_ROWS = 16_384
ROOT_SPLITS = 32
ROOT_ROWS = 512          # rows that the root's split points are chosen from, of all vector lengths
ANCHOR_ROWS = 65_536     # anchors that share one copy of the trees
QUERY_ROWS = 1024        # anchors searched at once
SLACK = 1e-6             # of the largest norm: rounding errors of distances near zero are roots of those of their squares
NONE = -(1 << 62)        # below every score
TOP = 1 << 62


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where all partial sums fit them."""
    bound = np.sqrt(_norms(a).max(initial=0) * _norms(b).max(initial=0))
    if bound < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def spread_out(x: np.ndarray, most: int) -> np.ndarray:
    """Positions of up to ``most`` rows that are far from each other: each next one is the farthest from those chosen."""
    chosen, far = [0], np.full(len(x), np.inf)
    while True:
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if len(chosen) == most or far.max() <= 0:
            return np.array(chosen)
        chosen.append(int(far.argmax()))


@dataclass
class Splits:
    """Split points (whole numbers and their last coordinate) and the ranges to the subtrees, ``[point, subtree]``."""

    points: np.ndarray
    last: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def distances(self, q: np.ndarray, square: float) -> np.ndarray:
        """Distances (anchors x points) of anchors, whose own last coordinate is 0."""
        scores = q.astype(np.float64) @ self.points.T.astype(np.float64)
        return np.sqrt(np.maximum(_norms(q)[:, None] + square - 2 * scores, 0))

    def reach(self, d: np.ndarray, low: np.ndarray, high: np.ndarray, child: int, slack: float) -> np.ndarray:
        """Which anchors can have a row of the annulus ``[low, high]`` in the subtree."""
        nearest = np.maximum(d - high[:, None], low[:, None] - d) - slack
        farthest = d + high[:, None] + slack
        return ((self.near[:, child] <= farthest) & (self.far[:, child] >= nearest)).all(axis=1)


def annulus(low: np.ndarray, high: np.ndarray, norm: np.ndarray, square: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances ``[inner, outer]`` of rows whose scores are in ``[low, high]``."""
    inner = np.sqrt(np.maximum(norm + square - 2.0 * high, 0)) - slack
    outer = np.sqrt(np.maximum(norm + square - 2.0 * low, 0)) + slack
    return inner, outer


class Tree:
    """A shard's rows in leaf order with the nodes above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, splits: int = SPLITS, leaf_rows: int = LEAF_ROWS):
        norms = _norms(rows)
        self.square = float(norms.max(initial=0))
        last = np.sqrt(np.maximum(self.square - norms, 0))
        lifted = np.concatenate((rows.astype(np.float64), last[:, None]), axis=1)
        order = np.arange(len(ids))
        # a node: its first child and their number (0: a leaf), and the place of its rows
        self.nodes, self.splits, at = [(0, 0, 0, len(ids))], {}, 0
        while at < len(self.nodes):
            a, b = self.nodes[at][2:]
            own, step = order[a:b], max(1, (b - a) // (4 * splits))
            points = own[spread_out(lifted[own[::step]], splits) * step] if b - a > leaf_rows else own[:0]
            if len(points) > 1:
                distance = np.stack([np.linalg.norm(lifted[own] - p, axis=1) for p in lifted[points]], axis=1)
                cell = distance.argmin(axis=1)
                by = np.argsort(cell, kind="stable")
                order[a:b], distance, cell = own[by], distance[by], cell[by]
                starts = np.searchsorted(cell, np.arange(len(points) + 1))  # no cell is empty: a point is nearest to itself
                self.nodes[at] = (len(self.nodes), len(points), a, b)
                self.splits[at] = Splits(rows[points], last[points], np.minimum.reduceat(distance, starts[:-1]).T, np.maximum.reduceat(distance, starts[:-1]).T)
                self.nodes += [(0, 0, a + i, a + j) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            at += 1
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.visits = 0

    def dump(self) -> bytes:
        out = io.BytesIO()
        least = next(t for t in (np.int16, np.int32, np.int64) if abs(self.rows).max(initial=0) <= np.iinfo(t).max)
        parts = {"ids": self.ids, "labels": self.labels, "rows": self.rows.astype(least), "nodes": np.array(self.nodes, np.int64), "square": self.square}
        for node, s in self.splits.items():
            parts |= {f"{node}/points": s.points.astype(least), f"{node}/last": s.last, f"{node}/near": s.near, f"{node}/far": s.far}
        np.savez(out, **parts)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        tree = Tree.__new__(Tree)
        with np.load(io.BytesIO(data)) as f:
            tree.ids, tree.labels, tree.rows = f["ids"], f["labels"], f["rows"].astype(np.int64)
            tree.nodes, tree.square, tree.visits = [tuple(n) for n in f["nodes"].tolist()], float(f["square"]), 0
            tree.splits = {i: Splits(f[f"{i}/points"].astype(np.int64), f[f"{i}/last"], f[f"{i}/near"], f[f"{i}/far"]) for i, n in enumerate(tree.nodes) if n[1]}
        return tree

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(anchors x k) scores and ids of the best rows with a score of ``[low, high]`` and the same (or another) label, best first."""
        norm, slack = _norms(q), SLACK * np.sqrt(max(self.square, _norms(q).max(initial=0)))
        best, found = np.full((len(ids), k), NONE), np.full((len(ids), k), TOP)
        seeded = np.full(len(ids), -1)

        def leaf(node: int, who: np.ndarray) -> None:
            self.visits += len(who)
            a, b = self.nodes[node][2:]
            scores = products(q[who], self.rows[a:b])
            floor = np.maximum(low[who], best[who, -1])
            fits = (scores >= floor[:, None]) & (scores <= high[who, None]) & (self.ids[a:b] != ids[who, None])
            fits &= (self.labels[a:b] == labels[who, None]) == same
            hit = np.flatnonzero(fits.any(axis=1))
            if not len(hit):
                return
            who, scores, fits = who[hit], scores[hit], fits[hit]
            all_scores = np.concatenate((best[who], np.where(fits, scores, NONE)), axis=1)
            all_ids = np.concatenate((found[who], np.where(fits, self.ids[a:b], TOP)), axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[who], found[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

        def seed(node: int, who: np.ndarray) -> None:
            """The leaf on every anchor's way to the nearest split points comes first, for a bound on the rest."""
            child, n = self.nodes[node][:2]
            if not n:
                seeded[who] = node
                return leaf(node, who)
            nearest = self.splits[node].distances(q[who], self.square).argmin(axis=1)
            for c in np.unique(nearest):
                seed(child + int(c), who[nearest == c])

        def descend(node: int, who: np.ndarray) -> None:
            child, n = self.nodes[node][:2]
            if not n:
                who = who[seeded[who] != node]
                return leaf(node, who) if len(who) else None
            splits = self.splits[node]
            d = splits.distances(q[who], self.square)
            for c in np.argsort(splits.near.mean(axis=0), kind="stable"):
                inner, outer = annulus(np.maximum(low[who], best[who, -1]), high[who], norm[who], self.square, slack)
                go = splits.reach(d, inner, outer, c, slack)
                if go.any():
                    descend(child + int(c), who[go])

        everyone = np.arange(len(ids))
        if same:
            seed(0, everyone)
        descend(0, everyone)
        return best, found


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def whole_numbers(table: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """``row, id, label, dim, v``: rows that take part, components as whole numbers in a binary column."""
    good = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            with np.errstate(over="ignore"):
                flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                squares = np.add.reduceat(flat**2, np.cumsum(dims) - dims) if len(dims) else flat
            if squares.max(initial=0) >= TOP:
                raise ValueError("scores of these vectors pass 2^62")
            rows = np.split(flat.astype("<i8"), np.cumsum(dims)[:-1])
            yield pa.record_batch({"id": b.column(0), "label": b.column(1), "dim": pa.array(dims.astype(np.int32)), "v": pa.array([r.tobytes() for r in rows[: len(dims)]], pa.binary())})

    out = good.mapInArrow(run, "id long, label long, dim int, v binary")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "gnat-rows")


class Root:
    """The first level: split points per vector length, and the cells' ranges once they are known."""

    def __init__(self, sample: list):
        self.splits, self.squares = {}, {}
        for dim in sorted({r["dim"] for r in sample}):
            rows = np.stack([np.frombuffer(r["v"], "<i8") for r in sample if r["dim"] == dim])
            points = rows[spread_out(rows.astype(np.float64), ROOT_SPLITS)]
            self.splits[dim] = Splits(points, None, None, None)

    def set_squares(self, squares: dict[int, float]) -> None:
        self.squares = squares
        for dim, s in self.splits.items():
            s.last = np.sqrt(np.maximum(squares[dim] - _norms(s.points), 0))

    def distances(self, dim: int, rows: np.ndarray) -> np.ndarray:
        """Distances (rows x points) of indexed rows."""
        s, square = self.splits[dim], self.squares[dim]
        last = np.sqrt(np.maximum(square - _norms(rows), 0))
        return np.sqrt(np.maximum(2 * square - 2 * (rows.astype(np.float64) @ s.points.T.astype(np.float64) + last[:, None] * s.last), 0))


SHARD = "dim int, cell int, sub int, "
QUERY = "anchor long, pos int, id long, label long, dim int, v binary, low long, high long"


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


class Index:
    """Trees of all shards (a stored table) and the root that leads to them."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS):
        spark = rows.sparkSession
        n = rows.count()
        mark = F.xxhash64("row")
        sample = rows.where(F.pmod(mark, F.lit(max(n, 1))) < 2 * ROOT_ROWS).orderBy(mark).limit(ROOT_ROWS).select("dim", "v").collect()
        # a length that the sample missed has one cell, around its first row
        firsts = rows.groupBy("dim").agg(F.min("v").alias("v")).collect()
        seen = {r["dim"] for r in sample}
        root = Root(sample + [r for r in firsts if r["dim"] not in seen])

        def squares(batches):
            for b in batches:
                for dim, part in _by_dim(b):
                    yield pa.record_batch({"dim": pa.array([dim], pa.int32()), "square": pa.array([_norms(_matrix(part.column("v"))).max()])})

        root.set_squares({r["dim"]: r["square"] for r in rows.select("dim", "v").mapInArrow(squares, "dim int, square double").groupBy("dim").agg(F.max("square").alias("square")).collect()})

        def assign(batches):
            for b in batches:
                for dim, part in _by_dim(b):
                    cell = root.distances(dim, _matrix(part.column("v"))).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "id", "label", "dim", "v")] + [pa.array(cell, pa.int32())], ["row", "id", "label", "dim", "v", "cell"])

        celled = stored(rows.select("row", "id", "label", "dim", "v").mapInArrow(assign, "row long, id long, label long, dim int, v binary, cell int"), "gnat-cells")
        self.subs = {(r["dim"], r["cell"]): max(1, -(-r["n"] // shard_rows)) for r in celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        counts = spark.createDataFrame([(d, c, s) for (d, c), s in self.subs.items()], "dim int, cell int, subs int")
        dealt = celled.join(F.broadcast(counts), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs").cast("int"))

        def build(group: pa.Table) -> pa.Table:
            rows_ = _matrix(group.column("v"))
            dim, cell, sub = (group.column(c)[0].as_py() for c in ("dim", "cell", "sub"))
            d = root.distances(dim, rows_)
            tree = Tree(group.column("id").to_numpy(), group.column("label").to_numpy(), rows_)
            return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "sub": pa.array([sub], pa.int32()),
                             "near": pa.array([d.min(axis=0).tolist()]), "far": pa.array([d.max(axis=0).tolist()]), "tree": pa.array([tree.dump()], pa.binary())})

        self.trees = stored(dealt.select("dim", "cell", "sub", "id", "label", "v").groupBy("dim", "cell", "sub")
                            .applyInArrow(build, SHARD + "near array<double>, far array<double>, tree binary"), "gnat-trees")
        # the cells' ranges: ROOT_SPLITS^2 numbers a vector length, whatever the rows
        ranges = (self.trees.select("dim", "cell", F.posexplode(F.arrays_zip("near", "far")).alias("point", "r")).groupBy("dim", "cell", "point")
                  .agg(F.min("r.near").alias("near"), F.max("r.far").alias("far")).collect())
        for dim, s in root.splits.items():
            s.near, s.far = np.full((len(s.points),) * 2, np.inf), np.full((len(s.points),) * 2, -np.inf)
            for r in ranges:
                if r["dim"] == dim:
                    s.near[r["point"], r["cell"]], s.far[r["point"], r["cell"]] = r["near"], r["far"]
        self.root = root

    def search(self, queries: DataFrame, k: int, same: bool, only: str = "all") -> DataFrame:
        """``anchor, pos, score, id``: up to ``k`` rows a shard and query, of the ``only`` cells ``own``, ``others`` or ``all``."""
        root, subs = self.root, self.subs
        blocks = max(1, -(-queries.count() // ANCHOR_ROWS))

        def route(batches):
            for b in batches:
                for dim, part in _by_dim(b):
                    q, low, high = _matrix(part.column("v")), part.column("low").to_numpy(), part.column("high").to_numpy()
                    splits, square = root.splits[dim], root.squares[dim]
                    slack = SLACK * np.sqrt(square)
                    d = splits.distances(q, square)
                    inner, outer = annulus(low, high, _norms(q), square, slack)
                    cells = [c for (x, c) in subs if x == dim]
                    own = np.array(cells)[d[:, cells].argmin(axis=1)]
                    for cell in cells:
                        go = splits.reach(d, inner, outer, cell, slack)
                        go &= (own == cell) if only == "own" else (own != cell) if only == "others" else True
                        if go.any():
                            chosen = part.filter(pa.array(go))
                            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.full(len(chosen), cell), pa.int32())], [*chosen.schema.names, "cell"])

        names = [c.split()[0] for c in QUERY.split(", ")]
        block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
        counts = queries.sparkSession.createDataFrame([(d, c, s) for (d, c), s in subs.items()], "dim int, cell int, subs int")
        sent = (queries.select(*names).mapInArrow(route, QUERY + ", cell int").join(F.broadcast(counts), ["dim", "cell"])
                .select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), block.alias("block"), *(c for c in names if c != "dim")))
        trees = self.trees.select("dim", "cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree")
        stream = trees.withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        keys = ("dim", "cell", "sub", "block")
        stream = stream.select(*keys, "kind", "tree", *(c for c in names if c != "dim")).repartition(*keys).sortWithinPartitions(*keys, "kind")
        schema = pa.schema([("anchor", pa.int64()), ("pos", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

        def run(batches):
            place = tree = data = None
            for b in batches:
                at = np.stack([b.column(c).to_numpy() for c in (*keys, "kind")])
                # a shard's tree comes first, if the shard has any row; the anchors up to the next shard are its own
                cuts = [0, *(np.flatnonzero((at[:4, 1:] != at[:4, :-1]).any(axis=0)) + 1).tolist(), at.shape[1]]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if place != tuple(at[:4, i]):
                        place, tree, data = tuple(at[:4, i]), None, None
                    if at[4, i] == 0:
                        data, i = b.column("tree")[i].as_py(), i + 1
                    if data is None:
                        continue
                    for a in range(i, j, QUERY_ROWS):
                        tree = tree or Tree.load(data)
                        part = b.slice(a, min(QUERY_ROWS, j - a))
                        best, found = tree.search(*(part.column(c).to_numpy() for c in ("id", "label")), _matrix(part.column("v")),
                                                  *(part.column(c).to_numpy() for c in ("low", "high")), k, same)
                        got = best > NONE
                        times = got.sum(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("anchor", "pos")]
                                                         + [pa.array(best[got]), pa.array(found[got])], schema=schema)

        return stream.mapInArrow(run, "anchor long, pos int, score long, id long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("anchor", "pos").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, label: Column, anchor: Column, positives: int, negatives: int, least_percent: int, id_col: str = "vec_id",
                   vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each of an anchor's best ``positives`` rows of its label, the best
    ``negatives`` rows of other labels that score at least ``least_percent``
    per cent of the positive's score and no more than it.  ``anchor`` picks
    the anchors by the column ``id``.
    """
    bounded_batches(table.sparkSession)
    rows = whole_numbers(table, label, id_col, vector_col)
    index = Index(rows, shard_rows)
    anchors = rows.where(anchor).select(F.col("row").alias("anchor"), F.lit(0).alias("pos"), "id", "label", "dim", "v", F.lit(NONE).alias("low"), F.lit(TOP).alias("high"))
    near = stored(_best(index.search(anchors, positives, True, "own"), positives).drop("rank"), "gnat-near")
    bound = near.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == positives)
    bounded = anchors.drop("low").join(bound.select("anchor", F.col("least").alias("low")), "anchor", "left").withColumn("low", F.coalesce("low", F.lit(NONE)))
    more = index.search(bounded, positives, True, "others")
    best = stored(_best(near.unionByName(more), positives).select("anchor", F.col("rank").alias("pos"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "gnat-positives")
    # 100 * negative >= least_percent * positive, in whole numbers
    score = F.col("positive_score")
    least = F.call_function("div", score, F.lit(100)) * least_percent + F.ceil(F.pmod(score, F.lit(100)) * F.lit(least_percent) / F.lit(100))
    windows = (anchors.drop("pos", "low", "high").join(best, "anchor").where(score >= 0)
               .select("anchor", "pos", "id", "label", "dim", "v", least.cast("long").alias("low"), score.alias("high")))
    found = _best(index.search(windows, negatives, False), negatives)
    named = best.join(rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "pos"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
