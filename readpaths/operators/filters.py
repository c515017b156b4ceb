"""Page-view filters (C1-C9, C14, C15) and the daily-volume filter (F1).

All predicates are plain column expressions, so Catalyst pushes them into
the scan (``PushedFilters``) and prunes partitions on ``year/month/day/hour``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.functions.columns import hour_not_before, normalize_wiki

DAY_KEYS = ("year", "month", "day")

# Defaults of the sessions job (fixed values of the reference job).
DEFAULT_DAYS = 8            # today - 8 days .. today
N_P_MIN = 1                 # minimum views per actor per day
N_P_MAX = 500               # maximum views per actor per day


def default_time_range(today: _dt.date | None = None, days: int = DEFAULT_DAYS) -> tuple[_dt.date, _dt.date]:
    """``[today - days, today)`` (the reference default, 8 days); days are UTC days, like all bounds."""
    today = today or _dt.datetime.now(_dt.timezone.utc).date()
    return today - _dt.timedelta(days=days), today


def resolve_time_range(start=None, end=None) -> tuple:
    """Both bounds or neither: one bound alone is an error (Q2)."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is None:
        return default_time_range()
    return start, end


def hour_range_filter(df: DataFrame, start, end) -> DataFrame:
    """Keep rows whose hour partition lies in ``[start, end)``.

    ``start`` / ``end`` are UTC instants (``YYYY-MM-DD``, ``YYYY-MM-DD-HH``
    or datetime).  The predicate compares partition columns with constants
    only, so a partitioned table is pruned before any file is opened, and by
    a metastore before any partition is listed.  Rows with a null part of
    the hour are dropped.
    """
    return df.where(hour_not_before(start)).where(~hour_not_before(end))


def pageview_filters(df: DataFrame, wiki_db: str | None = None,
                     project_family: str = "wikipedia") -> DataFrame:
    """Human page views of the main namespace of one family.

    * C2 ``is_pageview`` true (NULL dropped)
    * C3 ``agent_type = 'user'``
    * C4 ``access_method != 'mobile app'`` -- NULL is dropped as well
    * C5 ``normalized_host.project_family`` equals the family
    * C6 ``namespace_id = 0``
    * C7 ``wiki_db = normalized_host.project || 'wiki'``
    * C8 one wiki when ``wiki_db`` is given, else all wikis
    """
    out = (
        df.where(F.col("is_pageview"))
        .where(F.col("agent_type") == "user")
        .where(F.col("access_method") != "mobile app")
        .where(F.col("normalized_host.project_family") == project_family)
        .where(F.col("namespace_id") == 0)
        .withColumn("wiki_db", F.concat(F.col("normalized_host.project"), F.lit("wiki")))
    )
    wiki = normalize_wiki(wiki_db)
    if wiki is not None:
        out = out.where(F.col("wiki_db") == wiki)
    return out


def null_safe_semi(df: DataFrame, keys_df: DataFrame, keys, how: str = "left_semi") -> DataFrame:
    """``df`` semi/anti joined with ``keys_df`` on ``keys``, NULL matching NULL.

    The key columns of ``keys_df`` are renamed first so that a key table
    derived from ``df`` itself does not make the condition ambiguous.
    """
    keys = list(keys)
    renamed = keys_df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(renamed[f"_key{i}"])
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, how)


def daily_volume_filter(df: DataFrame, n_min: int | None = N_P_MIN, n_max: int | None = N_P_MAX,
                        actor_col: str = "actor", day_keys=DAY_KEYS) -> DataFrame:
    """Drop an actor's views of a day when that day has fewer than ``n_min``
    or more than ``n_max`` views (F1); other days of the actor stay.

    Written as a grouped count + semi join rather than a window: the count
    is partially aggregated before its shuffle, and the semi join is split
    by AQE when one actor-day is hot, whereas a window would sort a hot
    actor-day inside one task.  Keys compare NULL-safe, so NULL actors form
    one group as in the reference.
    """
    if n_min is None and n_max is None:
        return df
    keys = [actor_col, *day_keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_p"))
    if n_min is not None:
        counts = counts.where(F.col("_n_p") >= n_min)
    if n_max is not None:
        counts = counts.where(F.col("_n_p") <= n_max)
    return null_safe_semi(df, counts.drop("_n_p"), keys)


def clean_views(df: DataFrame) -> DataFrame:
    """Drop views without page id (C14) or without timestamp."""
    return df.where(F.col("page_id").isNotNull() & F.col("ts").isNotNull())
