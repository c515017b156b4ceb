"""Item map: latest item per page (A3, C9, F2, E2) and the view join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.functions.columns import normalize_wiki
from readpaths.session import stored

# Fixed value of the reference job: oldest item-link snapshot read.
DEFAULT_ITEM_SNAPSHOT_MIN = "2020-07-01"


def item_links_since(links: DataFrame, since: str = DEFAULT_ITEM_SNAPSHOT_MIN,
                     wiki_db: str | None = None) -> DataFrame:
    """Item links of snapshots ``>= since`` of wiki projects only.

    ``snapshot`` is a ``yyyy-MM-dd`` string (a partition column in the
    production table), so the string comparison prunes partitions.
    """
    out = links.where(F.col("snapshot") >= since).where(F.col("wiki_db").endswith("wiki"))
    wiki = normalize_wiki(wiki_db)
    if wiki is not None:
        out = out.where(F.col("wiki_db") == wiki)
    return out


def latest_item(links: DataFrame, since: str = DEFAULT_ITEM_SNAPSHOT_MIN,
                wiki_db: str | None = None) -> DataFrame:
    """One row per ``(wiki_db, page_id)`` with the item of the latest snapshot (F2 + E2).

    One ``max(struct(snapshot, item_id))`` aggregation replaces the
    reference's window + ``drop_duplicates``: it is partially aggregated
    before the shuffle (a hot page costs one row per map task), and the
    struct makes a snapshot tie deterministic (largest item id wins; a NULL
    item only wins when it is alone in the latest snapshot).
    """
    best = F.max(F.struct(F.col("snapshot"), F.col("item_id"))).alias("_best")
    return (
        item_links_since(links, since, wiki_db)
        .groupBy("wiki_db", "page_id")
        .agg(best)
        .select("wiki_db", "page_id", F.col("_best.item_id").alias("item_id"))
    )


def views_with_item(views: DataFrame, items: DataFrame) -> DataFrame:
    """Inner join of views and the item map on ``(page_id, wiki_db)``.

    Views of pages without an item disappear.  The item map is unique per
    key, so the join never multiplies views.  It is written to the shared
    folder and read back first: both join sides then come from exchanges of
    their own, and AQE can split the views of a hot page over several tasks
    (it cannot while the map is an aggregate inside the join's stage).  A
    small map (one wiki) still becomes a broadcast by its measured size.
    """
    return views.join(stored(items, "items"), on=["page_id", "wiki_db"], how="inner")
