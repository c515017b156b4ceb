"""Next-page evaluation.

The reference reads session lines, draws one consecutive pair per
session with ``random``, looks each source up one web call at a time and
averages the ranks in numpy.  Here the pair draw is a hash of the
session key and the seed, the lookup is a join with a neighbour table,
and the metrics are one aggregation -- a single distributed plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readpaths.functions.columns import md5int

MISS_RANK = 1e6                 # rank given to a target that is not listed
RECALL_KS = (1, 10, 50, 100)    # recall cut-offs of the reference metrics
METRIC_DIGITS = 9               # decimals of the reported metrics
METRIC_NAMES = {"n": "N", "mrr": "MRR", **{f"recall_at_{k}": f"Recall@{k}" for k in RECALL_KS}}


def pair_index(actor: Column, session_no: Column, n: Column, seed: str | int | None) -> Column:
    """0-based index ``i`` of the pair ``(seq[i], seq[i+1])`` of one session (K1, K2).

    ``md5int(actor|session|seed) % (n-1)``: uniform over the ``n-1`` pairs,
    deterministic for a seed, and the same in any SQL engine.
    """
    key = F.concat_ws("|", F.coalesce(actor, F.lit("")), session_no.cast("string"),
                      F.lit("" if seed is None else str(seed)))
    return F.pmod(md5int(key), (n - 1).cast("bigint"))


def query_pairs(sessions: DataFrame, seed: str | int | None = None) -> DataFrame:
    """One ``(src, trg)`` pair of consecutive pages per session of length >= 2 (K1).

    ``sessions`` has ``actor, session_no, page_ids`` (array in sequence
    order).  Returns ``actor, session_no, src, trg``.
    """
    n = F.size("page_ids")
    s = sessions.where(n >= 2)
    i = pair_index(F.col("actor"), F.col("session_no"), n, seed)
    return s.select("actor", "session_no",
                    F.element_at("page_ids", (i + 1).cast("int")).alias("src"),
                    F.element_at("page_ids", (i + 2).cast("int")).alias("trg"))


def pairs_from_lines(lines: DataFrame, seed: str | int | None = None, line_col: str = "value") -> DataFrame:
    """One pair per session text line (A5 + K1): ids split on a space.

    Text lines carry no actor or number, so a line's key is its text and
    its number among equal lines (``copy`` 1, 2, ...): every line draws for
    itself, as in the reference.  Returns ``line, copy, src, trg``.
    """
    line = F.trim(F.col(line_col))
    counted = lines.groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("_times"))
    ids = F.split("line", " ")
    s = counted.where(F.size(ids) >= 2).select("line", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("copy"))
    drawn = md5int(F.concat_ws("|", "line", F.col("copy").cast("string"), F.lit("" if seed is None else str(seed))))
    i = F.pmod(drawn, (F.size(ids) - 1).cast("bigint"))
    return s.select("line", "copy", F.element_at(ids, (i + 1).cast("int")).cast("bigint").alias("src"),
                    F.element_at(ids, (i + 2).cast("int")).cast("bigint").alias("trg"))


def limit_pairs(pairs: DataFrame, n_max: int | None = None, order=("actor", "session_no")) -> DataFrame:
    """First ``n_max`` pairs in session-key order.

    ``None`` or a negative number means all pairs, ``0`` means none (Q13).
    A top-n with an explicit order: each task keeps ``n_max`` rows.
    """
    if n_max is None or n_max < 0:
        return pairs
    return pairs.orderBy(*order).limit(int(n_max))


def target_ranks(pairs: DataFrame, neighbors: DataFrame, miss_rank: float = MISS_RANK) -> DataFrame:
    """Rank of each pair's target in its source's neighbour list (K5).

    ``neighbors`` has ``src, nn, rank`` (unique ``nn`` per ``src``).  A
    target that is not listed -- or a source without any neighbour --
    gets ``miss_rank``.  Adds a double column ``rank``.
    """
    nb = neighbors.select(F.col("src").alias("_src"), F.col("nn").alias("_nn"),
                          F.col("rank").alias("_rank"))
    cond = (F.col("src") == F.col("_src")) & (F.col("trg") == F.col("_nn"))
    return (pairs.join(nb, cond, "left")
            .withColumn("rank", F.coalesce(F.col("_rank").cast("double"), F.lit(float(miss_rank))))
            .drop("_src", "_nn", "_rank"))


def metric_columns(rank: Column | str = "rank", ks=RECALL_KS, miss_rank: float = MISS_RANK,
                   digits: int | None = None) -> list[Column]:
    """Aggregates of the metrics dict.

    MRR is the mean of ``1/rank`` -- a miss adds ``1/1e6``, not 0, as in
    the reference.  Recall@k is the share of ranks ``<= k`` that are not
    misses.  With no pair, MRR and the recalls are NULL.  Values are
    reported to ``digits`` decimals: the last bits of a distributed sum
    depend on the order in which partial sums arrive.
    """
    if digits is None:
        digits = METRIC_DIGITS
    r = F.col(rank) if isinstance(rank, str) else rank
    cols = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.lit(1.0) / r), digits).alias("mrr")]
    for k in ks:
        hit = F.when((r <= k) & (r != miss_rank), F.lit(1.0)).otherwise(F.lit(0.0))
        cols.append(F.round(F.avg(hit), digits).alias(f"recall_at_{k}"))
    return cols


def next_page_metrics(ranks: DataFrame, ks=RECALL_KS) -> DataFrame:
    """One row ``n, mrr, recall_at_1, ...`` (K6)."""
    return ranks.agg(*metric_columns("rank", ks))


def split_of(actor: Column | str = "actor") -> Column:
    """``'dev'`` or ``'test'`` from a hash of the actor."""
    a = F.col(actor) if isinstance(actor, str) else actor
    return F.when(md5int(F.coalesce(a, F.lit(""))) % 2 == 0, F.lit("dev")).otherwise(F.lit("test"))


def metrics_by_split(ranks: DataFrame, ks=RECALL_KS) -> DataFrame:
    """Metrics per dev / test split (K7): ``split, n, mrr, recall_at_...``."""
    return ranks.groupBy(split_of("actor").alias("split")).agg(*metric_columns("rank", ks))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """The metrics row as the reference's JSON line (B4): column ``json``.

    Keys are ``N, MRR, Recall@1, ...``; a grouping column such as
    ``split`` is kept next to it.
    """
    named = [F.col(c).alias(METRIC_NAMES.get(c, c)) for c in metrics.columns if c in METRIC_NAMES]
    keep = [c for c in metrics.columns if c not in METRIC_NAMES]
    return metrics.select(*keep, F.to_json(F.struct(*named)).alias("json"))
