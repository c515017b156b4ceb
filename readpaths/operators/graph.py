"""Link-graph operators.

Pages, redirects and links of one wiki snapshot become a redirect-resolved
edge list and a node list with items.  All joins are equi-joins; the
largest input (links) is joined on title and on target id, where a very
popular target is a hot key: AQE's skew split handles it, and the
redirect map -- the small side of the target join -- becomes a broadcast
at run time only when its measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.functions.columns import normalize_wiki
from readpaths.session import stored


def snapshot_select(df: DataFrame, wiki_db: str, snapshot: str) -> DataFrame:
    """Rows of one wiki and one snapshot (A2): equality on partition columns."""
    return df.where(F.col("wiki_db") == normalize_wiki(wiki_db)).where(F.col("snapshot") == snapshot)


def main_namespace_pages(page: DataFrame, wiki_db: str, snapshot: str) -> DataFrame:
    """Pages of namespace 0, redirects included (I1): ``page_id, page_title, page_is_redirect``."""
    return (snapshot_select(page, wiki_db, snapshot)
            .where(F.col("page_namespace") == 0)
            .select("page_id", "page_title", "page_is_redirect"))


def redirect_map(redirect: DataFrame, pages: DataFrame, wiki_db: str, snapshot: str) -> DataFrame:
    """Redirect source id -> target id, one hop (I2, D2): ``rd_from, rd_to``.

    Only namespace-0 targets; a redirect whose target title is not a page
    vanishes in the inner join.  The target may itself be a redirect.
    """
    rd = (snapshot_select(redirect, wiki_db, snapshot)
          .where(F.col("rd_namespace") == 0)
          .select(F.col("rd_from").alias("_from"), F.col("rd_title").alias("page_title")))
    return (rd.join(pages.select("page_title", "page_id"), "page_title", "inner")
            .select(F.col("_from").alias("rd_from"), F.col("page_id").alias("rd_to")))


def redirect_chains(redirects: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Redirect source -> the page its chain of redirects leads to (Q10 option): ``rd_from, rd_to, in_cycle``.

    ``redirects`` is a ``redirect_map``; a chain is followed for ``max_hops``
    hops at most (``None``: to its end).  A chain that runs into a cycle has
    no end: its source keeps the target of one hop and is marked.  A source
    with several targets takes the smallest.

    Pointer doubling: ``jump`` leads ``2^i`` hops ahead, or to the chain's
    end, and is joined with itself, so a chain of n hops takes ``log2(n)``
    rounds.  The hops left over are made up of jumps of the powers of two in
    ``max_hops``.  A pointer that still stands on a redirect after as many
    hops as there are redirects is in a cycle.  Every round is stored.
    """
    if max_hops is not None and max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    one = stored(redirects.groupBy("rd_from").agg(F.min("rd_to").alias("rd_to")), "redirects")

    def ahead(pointers: DataFrame, jump: DataFrame) -> DataFrame:
        """Each pointer moved by a jump; one that stands on no redirect stays."""
        to = jump.select(F.col("rd_from").alias("_on"), F.col("rd_to").alias("_next"))
        return (pointers.join(to, pointers["rd_to"] == to["_on"], "left")
                .select("rd_from", F.coalesce("_next", "rd_to").alias("rd_to")))

    # until no pointer moves, or as many hops are followed as there are redirects (then what moves is in a cycle)
    total = one.count()
    hops, jump, out, left = 1, one, one, (total if max_hops is None else min(max_hops, total)) - 1
    while left > 0:
        if left & hops:
            out, left = stored(ahead(out, jump), "redirect-ends"), left - hops
        if left > 0:
            now = stored(ahead(jump, jump), "redirect-jumps")
            moved = now.join(jump.select("rd_from", F.col("rd_to").alias("_before")), "rd_from").where("rd_to <> _before").limit(1).count()
            jump, hops = now, 2 * hops
            if not moved:  # the ends of all chains are known
                out, left = jump, 0
    if max_hops is not None and max_hops < total:
        # a chain may be longer than asked for without being a cycle
        cycles = redirect_chains(one).where("in_cycle").select("rd_from", F.lit(True).alias("in_cycle"))
    else:
        on = one.select(F.col("rd_from").alias("rd_to"))
        cycles = out.join(on, "rd_to", "left_semi").select("rd_from", F.lit(True).alias("in_cycle"))
    first = one.select("rd_from", F.col("rd_to").alias("_one"))
    ends = out.join(cycles, "rd_from", "left").join(first, "rd_from").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    return ends.select("rd_from", F.when(F.col("in_cycle"), F.col("_one")).otherwise(F.col("rd_to")).alias("rd_to"), "in_cycle")


def links_from_content_pages(pagelinks: DataFrame, redirects: DataFrame, wiki_db: str,
                             snapshot: str) -> DataFrame:
    """Namespace-0 links whose source is not a resolvable redirect.

    "Not a redirect" means *not in the redirect map*, so a redirect with a
    missing target keeps its links.  Returns ``page_id_from, page_title``.
    """
    pl = (snapshot_select(pagelinks, wiki_db, snapshot)
          .where(F.col("pl_from_namespace") == 0)
          .where(F.col("pl_namespace") == 0)
          .select(F.col("pl_from").alias("page_id_from"), F.col("pl_title").alias("page_title")))
    return pl.join(redirects.select(F.col("rd_from").alias("page_id_from")), "page_id_from", "left_anti")


def links_by_id(content_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Map link target titles to ids; dangling links vanish.

    Returns ``page_id_from, page_id_to``.
    """
    return (content_links.join(pages.select("page_title", "page_id"), "page_title", "inner")
            .select("page_id_from", F.col("page_id").alias("page_id_to")))


def resolve_redirects(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """Replace a redirect target by its destination, one hop, then distinct.

    Self-loops created by the resolution stay, as in the reference.
    """
    rd = redirects.select(F.col("rd_from").alias("_rd_from"), F.col("rd_to").alias("_rd_to"))
    resolved = (links.join(rd, links["page_id_to"] == rd["_rd_from"], "left")
                .select("page_id_from", F.coalesce(F.col("_rd_to"), F.col("page_id_to")).alias("page_id_to")))
    return resolved.distinct()


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids occurring as source or target of an edge (S1, D6, E4): ``page_id``.

    One pass over the edges: both ends of each, partially de-duplicated
    before the only shuffle.
    """
    ends = F.explode(F.array("page_id_from", "page_id_to"))
    return edges.select(ends.alias("page_id")).where(F.col("page_id").isNotNull()).distinct()


def graph_nodes(pages: DataFrame, endpoints: DataFrame, items: DataFrame) -> DataFrame:
    """Pages that occur in an edge, with their latest item or NULL.

    Returns ``page_id, page_title, item_id``.  ``items`` is the item map of
    the same wiki (``page_id, item_id``, unique per page).
    """
    return (pages.join(endpoints, "page_id", "left_semi")
            .join(items.select("page_id", "item_id"), "page_id", "left")
            .select("page_id", "page_title", "item_id"))


def graph_edges(page: DataFrame, redirect: DataFrame, pagelinks: DataFrame,
                wiki_db: str, snapshot: str, max_hops: int | None = 1) -> DataFrame:
    """Edge list of one wiki snapshot (I2 + I3 + I4): ``page_id_from, page_id_to``.

    Redirects are resolved one hop, as in the reference; ``max_hops`` follows
    chains further, ``None`` to their ends.
    """
    pages = main_namespace_pages(page, wiki_db, snapshot)
    rd = redirect_map(redirect, pages, wiki_db, snapshot)
    links = links_by_id(links_from_content_pages(pagelinks, rd, wiki_db, snapshot), pages)
    return resolve_redirects(links, rd if max_hops == 1 else redirect_chains(rd, max_hops))


def title_lookup(ids: DataFrame, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Page title for each id, ``''`` when the page is unknown.

    A left join to the page table replaces one web call per id.
    """
    p = pages.select(F.col("page_id").alias("_pid"), F.col("page_title").alias("_title"))
    return (ids.join(p, ids[id_col] == p["_pid"], "left")
            .drop("_pid")
            .withColumn("page_title", F.coalesce(F.col("_title"), F.lit("")))
            .drop("_title"))
