"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells, one per combination of the dimensions (source,
language, topic).  The cells' token weights are raked: scaled to each
dimension's target shares in turn until no scaling changes a weight by more
than ``TOLERANCE``.  Documents are then drawn with a probability per cell,
calibrated so that the expected tokens are the raked shares of the budget;
a cell that has too few tokens is taken whole and the rest of the budget goes
to the others in proportion.

All of it is DataFrame expressions: documents are aggregated to cells once
(the hot source is combined before the shuffle), raking runs on cells, and
only scalars reach the driver.  Draws hash the id, so they are the same in
any run and on any partitioning.

Cases: null dimension values form a value of their own; a null text has no
tokens and counts for its cell with weight 0; rows with equal ids are drawn
alike, a null id is drawn by its text; target shares of absent values are
left out and the others scaled up, values without a target get nothing;
targets that no weights can meet end after ``SWEEPS`` sweeps at the last
fit, with a ``MarginWarning`` that names the largest error of a share (so does
a budget that ``CALIBRATION_ROUNDS`` do not meet); an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from readpaths.llm.shared import stored

SWEEPS = 40
TOLERANCE = 1e-6
CALIBRATION_ROUNDS = 60
ALPHA = 0.5  # default targets: shares of the tokens to this power
SEED = 20


class MarginWarning(UserWarning):
    """A fit that ended before its targets were met."""


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, and prose by its length."""
    return (F.when(text.contains(" | "), "table").when(F.length(text) < 1000, "brief")
            .when(F.length(text) < 5000, "article").otherwise("long"))


def tempered(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """Default target ``value, share`` of a dimension: token shares to the power ``alpha``."""
    by = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("share"))
    return by.where("share > 0")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``weight``, which sums to 1 and meets the targets' shares."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        there = target.join(cells.where("tokens > 0").select(F.col(dim).alias("there")).distinct(), F.col("value").eqNullSafe(F.col("there")), "left_semi")
        total = there.agg(F.sum("share")).first()[0] or 1.0
        named = stored(there.select(F.col("value").alias(f"value_{dim}"), (F.col("share") / F.lit(total)).alias(f"share_{dim}")), "target")
        now = now.join(named, F.col(dim).eqNullSafe(F.col(f"value_{dim}")), "left").drop(f"value_{dim}")
    now = stored(now.na.fill(0.0, [f"share_{d}" for d in targets]), "cells")
    for _ in range(sweeps):
        step = now
        for dim in targets:
            margin = F.sum("weight").over(W.partitionBy(dim))
            factor = F.when(margin > 0, F.col(f"share_{dim}") / margin).otherwise(F.lit(1.0))
            step = step.withColumn(f"factor_{dim}", factor).withColumn("weight", F.col("weight") * F.col(f"factor_{dim}"))
        now = stored(step, "rake")
        moved = F.greatest(*[F.abs(F.col(f"factor_{d}") - 1) for d in targets], F.lit(0.0))
        change = now.where("weight > 0").agg(F.max(moved)).first()[0]
        now = now.drop(*[f"factor_{d}" for d in targets])
        if change is None or change <= tolerance:
            break
    else:
        warnings.warn(f"raking ended after {sweeps} sweeps; largest error of a share: {margin_error(now, targets):.2g}", MarginWarning, stacklevel=2)
    total = now.agg(F.sum("weight")).first()[0] or 1.0
    return now.drop(*[f"share_{d}" for d in targets]).withColumn("weight", F.col("weight") / F.lit(total))


def margin_error(raked: DataFrame, targets: Mapping[str, DataFrame]) -> float:
    """The largest distance of a value's share of the weight from its target in ``share_<dimension>``."""
    total, worst = raked.agg(F.sum("weight")).first()[0] or 1.0, 0.0
    for dim in targets:
        margins = raked.groupBy(dim, f"share_{dim}").agg(F.sum("weight").alias("weight"))
        worst = max(worst, margins.agg(F.max(F.abs(F.col("weight") / F.lit(total) - F.col(f"share_{dim}")))).first()[0] or 0.0)
    return worst


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with ``probability = min(1, c * weight / tokens)``, where c makes the expected tokens ``budget``.

    Cells that reach 1 are fixed and the rest scaled again; each round is one
    aggregate, and the number of full cells only grows.
    """
    c = budget
    wish = F.col("weight") / F.col("tokens")
    for _ in range(CALIBRATION_ROUNDS):
        full = wish * F.lit(c) >= 1
        s = cells.where("tokens > 0 and weight > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not s["open"]:
            break
        scaled = (budget - (s["full"] or 0)) / s["open"]
        if scaled <= c * (1 + 1e-12):
            break
        c = scaled
    else:
        warnings.warn(f"calibration ended after {CALIBRATION_ROUNDS} rounds", MarginWarning, stacklevel=2)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), wish * F.lit(c)))
    return cells.withColumn("probability", F.coalesce(p, F.when(F.col("weight") > 0, 1.0).otherwise(0.0)))


def mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, budget_share: float, targets: Mapping[str, DataFrame] | None = None,
        id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and ``mix`` (struct of the dimensions,
    ``tokens``, ``weight`` and ``probability``).

    ``dims`` maps a dimension's name to its expression over ``docs``;
    ``budget_share`` is the budget as a share of all tokens; ``targets`` has a
    DataFrame ``value, share`` for dimensions whose target is not the default.
    """
    names = list(dims)
    key = F.struct(*[e.cast("string").alias(n) for n, e in dims.items()], tokens.cast("long").alias("tokens"))
    ident = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
    draw = F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), draw.alias("draw"))
    cells = stored(keyed.groupBy(*[F.col(f"key.{n}").alias(n) for n in names]).agg(F.sum("key.tokens").alias("tokens")), "cells")
    raked = rake(cells, {n: (targets or {}).get(n, tempered(cells, n)) for n in names})
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    drawn = stored(calibrate(raked, budget_share * total).select(F.struct(*names).alias("cell"), "weight", "probability"), "probabilities")
    same = None
    for n in names:
        one = F.col(f"key.{n}").eqNullSafe(F.col(f"cell.{n}"))
        same = one if same is None else same & one
    mixed = F.struct(*[F.col(f"key.{n}").alias(n) for n in names], F.col("key.tokens").alias("tokens"), "weight", "probability")
    return keyed.join(drawn, same).where(F.col("draw") < F.col("probability")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "mix"], mixed.alias("mix"))
