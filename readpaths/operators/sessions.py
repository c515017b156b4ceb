"""Reading-session operators.

Input is a flat table of views, one row per page view::

    actor, ts, page_id, page_title, wiki_db, qid

The reference builds one array per actor and loops over it in Python.
Here every step is a grouped aggregate or a join, so that no step needs
an actor's whole history in one task (a heavy reader -- or the NULL
actor, which is one group -- may hold a large share of all views):

* H1 blacklist  -> a per-view flag, carried through the dedupe aggregate
                   and turned into an actor-level drop on the bucket table
                   (``blacklist_actors`` is the stand-alone anti-join form)
* H3 dedupe     -> ``min(struct(ts, ...))`` per (actor, page): partial agg
* H4 split      -> per (actor, dt-wide time bucket) count/min/max, then a
                   running sum over the *bucket* table (a few rows per
                   actor and hour), joined back to the views
* H5 length     -> summed bucket counts per session, before the join
* H6 serialise  -> ``collect_list`` only per kept session (<= 30 views)

The order of the struct fields is the order of the reference's sorted
sequence: ``ts`` first, ties broken by page id, title, wiki and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readpaths.functions.columns import bucket_of, epoch_micros
from readpaths.operators.filters import null_safe_semi
from readpaths.session import stored

# Fixed values of the reference job.
DEFAULT_DT_SECONDS = 3600       # gap that splits sessions
DEFAULT_MIN_LENGTH = 2          # shortest session kept
DEFAULT_MAX_LENGTH = 30         # longest session kept (longer ones are dropped)
DEFAULT_BLACKLIST = ("Q5296",)  # item of the main page

FLAG = "_blacklisted"  # column of views whose item is blacklisted

SEQ_FIELDS = ("ts", "page_id", "page_title", "wiki_db", "qid")


def view_struct() -> Column:
    """Sort key of a view inside a sequence (the whole struct, E1)."""
    return F.struct(*[F.col(c) for c in SEQ_FIELDS])


def sequence_views(df: DataFrame, actor_col: str = "actor",
                   item_col: str = "item_id") -> DataFrame:
    """Project joined page views to the sequence shape.

    ``page_title`` is read from ``pageview_info`` (map or struct) when the
    column is not already there.
    """
    title = F.col("page_title") if "page_title" in df.columns else F.col("pageview_info.page_title")
    flag = [FLAG] if FLAG in df.columns else []
    return df.select(
        F.col(actor_col).alias("actor"),
        "ts",
        "page_id",
        title.alias("page_title"),
        "wiki_db",
        F.col(item_col).alias("qid"),
        *flag,
    )


def actor_sequences(views: DataFrame, max_views: int) -> DataFrame:
    """Time-sorted array of view structs per actor.

    An actor with more than ``max_views`` views raises: the array of one
    actor is one row, so the caller must have bounded it (the daily cap F1
    bounds it by its maximum times the number of days).  The session
    operators below do not collect actors.
    """
    seq = views.groupBy("actor").agg(F.array_sort(F.collect_list(view_struct())).alias("session"), F.count(F.lit(1)).alias("_n"))
    guard = F.when(F.col("_n") > max_views, F.raise_error(F.lit(f"an actor has more than {max_views} views")).cast("boolean")).otherwise(F.lit(True))
    return seq.where(guard).drop("_n")


def blacklist_actors(views: DataFrame, blacklist=DEFAULT_BLACKLIST) -> DataFrame:
    """Drop every view of an actor who viewed a blacklisted item (H1).

    The reference drops the whole actor sequence, not one session (Q7).
    ``blacklist`` is a list of item ids (a literal ``IN`` predicate) or a
    one-column DataFrame ``qid``.  Runs after NULL timestamps are gone.
    """
    if isinstance(blacklist, DataFrame):
        hits = views.join(stored(blacklist.select(F.col(blacklist.columns[0]).alias("qid")).distinct(), "blacklist"), "qid", "left_semi")
    else:
        items = list(blacklist)
        if not items:
            return views
        hits = views.where(F.col("qid").isin(items))
    bad = hits.select("actor").distinct()
    return null_safe_semi(views, bad, ["actor"], how="left_anti")


def first_visits(views: DataFrame, keys=("page_id",), flag: str | None = None) -> DataFrame:
    """Keep the first view of each page per actor, over the actor's whole
    sequence (H3; the reference key ignores the wiki, Q8).

    ``min(struct)`` over the sequence order picks exactly the view the
    reference keeps, as a partially aggregated group-by.  With ``flag`` (a
    boolean column of ``views``) the kept row carries whether *any* view
    of that page was flagged.
    """
    aggs = [F.min(view_struct()).alias("_v")]
    if flag:
        aggs.append(F.max(F.col(flag)).alias(flag))
    return (views.groupBy("actor", *keys).agg(*aggs)
            .select("actor", *[F.col(f"_v.{c}").alias(c) for c in SEQ_FIELDS], *([flag] if flag else [])))


def _bucket_sessions(views: DataFrame, dt_seconds: int, min_length: int | None,
                     max_length: int | None, drop_flag: str | None = None) -> DataFrame:
    """Session number per (actor, time bucket), with session lengths.

    Buckets are ``dt`` wide, so two views of one bucket are less than
    ``dt`` apart and never split a session; only the first view of a
    bucket can start one, when the latest view of the previous non-empty
    bucket is more than ``dt`` earlier.
    """
    dt_us = int(dt_seconds) * 1_000_000
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi")]
    if drop_flag:
        aggs.append(F.max(F.col(drop_flag)).alias("_drop"))
    per_bucket = (
        views.select("actor", epoch_micros("ts").alias("_us"), *([drop_flag] if drop_flag else []))
        .withColumn("_b", bucket_of("_us", dt_us))
        .groupBy("actor", "_b")
        .agg(*aggs)
    )
    if drop_flag:
        # actor-level: one flagged view anywhere drops every bucket of the actor
        per_bucket = (per_bucket.withColumn("_drop", F.max("_drop").over(Window.partitionBy("actor")))
                      .where(~F.col("_drop")).drop("_drop"))
    by_time = Window.partitionBy("actor").orderBy("_b")
    prev_hi = F.lag("_hi").over(by_time)
    starts = per_bucket.withColumn(
        "_start", F.when(prev_hi.isNull() | ((F.col("_lo") - prev_hi) > dt_us), 1).otherwise(0))
    numbered = starts.withColumn(
        "session_no",
        F.sum("_start").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    sized = numbered.withColumn(
        "session_length", F.sum("_n").over(Window.partitionBy("actor", "session_no")).cast("int"))
    if min_length is not None:
        sized = sized.where(F.col("session_length") >= min_length)
    if max_length is not None:
        sized = sized.where(F.col("session_length") <= max_length)
    return sized.select("actor", "_b", "session_no", "session_length")


def gap_sessions(views: DataFrame, dt_seconds: int = DEFAULT_DT_SECONDS,
                 min_length: int | None = None, max_length: int | None = None,
                 drop_flag: str | None = None) -> DataFrame:
    """Split each actor's views into sessions at gaps longer than ``dt`` (H4).

    A gap of exactly ``dt`` keeps the session.  Adds ``session_no`` (1, 2,
    ... in time order per actor, counted before any length filter) and
    ``session_length``; with ``min_length`` / ``max_length`` only views of
    sessions in that range are returned (H5: too long is dropped, not cut).
    Views must be deduplicated first (H3) for the reference's semantics.
    With ``drop_flag`` (a boolean column), every view of an actor with a
    flagged view is dropped -- the blacklist, decided on the small bucket
    table instead of by a separate anti join.
    """
    dt_us = int(dt_seconds) * 1_000_000
    keyed = views.withColumn("_b", bucket_of(epoch_micros("ts"), dt_us))
    if drop_flag:
        keyed = keyed.drop(drop_flag)
    buckets = _bucket_sessions(views, dt_seconds, min_length, max_length, drop_flag)
    right = buckets.select(F.col("actor").alias("_actor"), F.col("_b").alias("_rb"),
                           "session_no", "session_length")
    joined = keyed.join(right, keyed["actor"].eqNullSafe(right["_actor"]) & (keyed["_b"] == right["_rb"]),
                        "inner")
    return joined.drop("_actor", "_rb", "_b")


def session_lines(sessions: DataFrame, max_length: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """One row per session: ``actor, session_no, n_views, page_ids, line`` (H6).

    ``line`` is the page ids in sequence order joined by a space -- the
    reference's output line.  The collect is bounded: callers pass the
    views of sessions of at most ``max_length`` views (H5).
    """
    if max_length is None:
        raise ValueError("session_lines needs max_length: the per-session collect must stay bounded")
    ordered = F.array_sort(F.collect_list(view_struct()))
    out = (sessions.groupBy("actor", "session_no")
           .agg(ordered.alias("_seq"))
           .select("actor", "session_no",
                   F.size("_seq").alias("n_views"),
                   F.transform("_seq", lambda e: e["page_id"]).alias("page_ids")))
    out = out.where(F.col("n_views") <= max_length)
    return out.withColumn("line", F.concat_ws(" ", F.transform("page_ids", lambda p: p.cast("string"))))


def reading_sessions(views: DataFrame, dt_seconds: int = DEFAULT_DT_SECONDS,
                     min_length: int = DEFAULT_MIN_LENGTH, max_length: int = DEFAULT_MAX_LENGTH,
                     blacklist=DEFAULT_BLACKLIST, dedupe_keys=("page_id",)) -> DataFrame:
    """C15 -> H1 -> H3 -> H4 -> H5 -> H6 on flat views (the session half of H7).

    The step order matters and is the reference's: NULL timestamps go
    first, the blacklist looks at the whole actor, dedupe runs over the
    whole actor before the split, and the length window is applied last.

    Views that carry the column ``FLAG`` (the job sets it on the item map,
    one row per page) use it; otherwise ``blacklist`` is matched on ``qid``.
    The first visits feed both the bucket table and the join back, so they
    are written once.
    """
    clean = views.where(F.col("ts").isNotNull() & F.col("page_id").isNotNull())
    flag = FLAG if FLAG in clean.columns else None
    if flag is None and blacklist is not None:
        clean, flag = flag_blacklisted(clean, blacklist), FLAG
    firsts = stored(first_visits(clean, keys=dedupe_keys, flag=flag), "first-visits")
    split = gap_sessions(firsts, dt_seconds, min_length=min_length, max_length=max_length, drop_flag=flag)
    return session_lines(split, max_length=max_length)


def flag_blacklisted(df: DataFrame, blacklist, flag: str = "_blacklisted", item_col: str = "qid") -> DataFrame:
    """Add a boolean ``flag``: the row's item is blacklisted.

    A list is a literal ``IN``; a one-column DataFrame of item ids is
    de-duplicated, written and left-joined.
    """
    if isinstance(blacklist, DataFrame):
        bl = stored(blacklist.select(F.col(blacklist.columns[0]).alias("_bl_qid")).distinct(), "blacklist").withColumn(flag, F.lit(True))
        return (df.join(bl, df[item_col] == bl["_bl_qid"], "left")
                .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_bl_qid"))
    items = list(blacklist)
    return df.withColumn(flag, F.coalesce(F.col(item_col).isin(items), F.lit(False)) if items else F.lit(False))
