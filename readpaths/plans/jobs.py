"""Whole jobs composed from the operators.

Each job takes DataFrames (already scanned tables) and parameters and
returns DataFrames; writing is left to the caller or to the ``run_*``
helpers, which write to a shared folder and read back what a later step
needs instead of recomputing it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths.functions.columns import normalize_wiki
from readpaths.operators import evaluate as ev
from readpaths.operators import filters as flt
from readpaths.operators import graph as gr
from readpaths.operators import items as it
from readpaths.operators import models as md
from readpaths.operators import neighbors as nb
from readpaths.operators import sessions as ss
from readpaths.operators import subwords as sw
from readpaths.operators import text as tx
from readpaths.session import stored
from readpaths.sinks import writers as wr


def session_views(pageviews: DataFrame, item_links: DataFrame, start, end, wiki_db: str | None = "enwiki",
                  n_p_min: int | None = flt.N_P_MIN, n_p_max: int | None = flt.N_P_MAX,
                  item_since: str = it.DEFAULT_ITEM_SNAPSHOT_MIN, actor_col: str = "actor", blacklist=None) -> DataFrame:
    """Filtered page views with their item, in sequence shape.

    With ``blacklist`` the flag for H1 is set on the item map, one row per
    page, and comes with the join.
    """
    views = flt.hour_range_filter(pageviews, start, end)
    views = flt.pageview_filters(views, wiki_db)
    views = flt.daily_volume_filter(views, n_p_min, n_p_max, actor_col=actor_col)
    items = it.latest_item(item_links, item_since, wiki_db)
    if blacklist is not None:
        items = ss.flag_blacklisted(items, blacklist, ss.FLAG, "item_id")
    return ss.sequence_views(it.views_with_item(views, items), actor_col=actor_col)


def dedupe_keys_for(wiki_db: str | None) -> tuple[str, ...]:
    """Dedupe key: page id within one wiki; wiki and page id across wikis (Q8)."""
    return ("page_id",) if normalize_wiki(wiki_db) is not None else ("wiki_db", "page_id")


def reading_sessions_job(pageviews: DataFrame, item_links: DataFrame, start=None, end=None,
                         wiki_db: str | None = "enwiki", n_p_min: int | None = flt.N_P_MIN,
                         n_p_max: int | None = flt.N_P_MAX, item_since: str = it.DEFAULT_ITEM_SNAPSHOT_MIN,
                         dt_seconds: int = ss.DEFAULT_DT_SECONDS, min_length: int = ss.DEFAULT_MIN_LENGTH,
                         max_length: int = ss.DEFAULT_MAX_LENGTH, blacklist=ss.DEFAULT_BLACKLIST,
                         actor_col: str = "actor") -> DataFrame:
    """The sessions job (H7): ``actor, session_no, n_views, page_ids, line``.

    ``start``/``end`` default to the last 8 days; give both or neither.
    """
    start, end = flt.resolve_time_range(start, end)
    views = session_views(pageviews, item_links, start, end, wiki_db, n_p_min, n_p_max, item_since, actor_col, blacklist)
    return ss.reading_sessions(views, dt_seconds, min_length, max_length, blacklist,
                               dedupe_keys=dedupe_keys_for(wiki_db))


def run_reading_sessions(spark: SparkSession, pageviews: DataFrame, item_links: DataFrame, out_dir: str,
                         start=None, end=None, wiki_db: str | None = "enwiki", **kw) -> str:
    """Write the session lines (gzip text, B2) under ``out_dir`` with the reference's name."""
    start, end = flt.resolve_time_range(start, end)
    sessions = reading_sessions_job(pageviews, item_links, start, end, wiki_db, **kw)
    fmt = lambda v: v if isinstance(v, str) else v.strftime("%Y-%m-%d-%H")
    path = f"{out_dir.rstrip('/')}/{wr.output_name('sessions', normalize_wiki(wiki_db) or wr.ALL_WIKIS, fmt(start), fmt(end))}"
    wr.write_lines(sessions, path)
    return path


def graph_job(page: DataFrame, redirect: DataFrame, pagelinks: DataFrame, item_links: DataFrame,
              wiki_db: str, snapshot: str, item_since: str = it.DEFAULT_ITEM_SNAPSHOT_MIN,
              edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of one wiki snapshot.

    Pass ``edges`` (e.g. the written edge table read back) to derive the
    nodes from it instead of from the edge plan.
    """
    pages = gr.main_namespace_pages(page, wiki_db, snapshot)
    if edges is None:
        edges = gr.graph_edges(page, redirect, pagelinks, wiki_db, snapshot)
    items = it.latest_item(item_links, item_since, wiki_db).select("page_id", "item_id")
    nodes = gr.graph_nodes(pages, gr.edge_endpoints(edges), items)
    return edges, nodes


def run_graph(spark: SparkSession, page: DataFrame, redirect: DataFrame, pagelinks: DataFrame,
              item_links: DataFrame, out_dir: str, wiki_db: str, snapshot: str, **kw) -> tuple[str, str]:
    """Write edges, read them back, derive and write nodes.

    Reading the written edges back cuts the lineage: the nodes do not
    recompute the edge plan, and a lost executor does not either.
    """
    wiki = normalize_wiki(wiki_db)
    edges, _ = graph_job(page, redirect, pagelinks, item_links, wiki, snapshot, **kw)
    e_path = f"{out_dir.rstrip('/')}/{wr.output_name('edges', wiki, snapshot)}"
    wr.write_parquet(edges, e_path)
    _, nodes = graph_job(page, redirect, pagelinks, item_links, wiki, snapshot,
                         edges=spark.read.parquet(e_path), **kw)
    n_path = f"{out_dir.rstrip('/')}/{wr.output_name('nodes', wiki, snapshot)}"
    wr.write_parquet(nodes, n_path)
    return e_path, n_path


def run_graph_partition(spark: SparkSession, page: DataFrame, redirect: DataFrame, pagelinks: DataFrame,
                        item_links: DataFrame, out_dir: str, wiki_db: str, snapshot: str, **kw) -> tuple[str, str]:
    """Write edges and nodes into the tables of all wikis, ``graph_edges`` and ``graph_nodes``.

    Each is partitioned by wiki and snapshot; a rerun replaces its own part
    only.  The nodes are derived from the written edges, as in ``run_graph``.
    """
    wiki, base = normalize_wiki(wiki_db), out_dir.rstrip("/")
    edges, _ = graph_job(page, redirect, pagelinks, item_links, wiki, snapshot, **kw)
    wr.write_partition(edges, f"{base}/graph_edges", wiki, snapshot)
    own = gr.snapshot_select(spark.read.schema("page_id_from long, page_id_to long, wiki_db string, snapshot string").parquet(f"{base}/graph_edges"), wiki, snapshot)
    _, nodes = graph_job(page, redirect, pagelinks, item_links, wiki, snapshot, edges=own.drop(*wr.PARTITIONS), **kw)
    wr.write_partition(nodes, f"{base}/graph_nodes", wiki, snapshot)
    return f"{base}/graph_edges", f"{base}/graph_nodes"


def dump_vectors_job(dump: DataFrame, word_vectors: DataFrame, digits: int | None = None, dimensions: int | None = None,
                     buckets: DataFrame | None = None, n_buckets: int = sw.N_BUCKETS) -> DataFrame:
    """Page dump -> articles -> lead text -> sentence vectors (J7): ``page_id, vector``.

    With ``dimensions`` the word vectors are reduced first (J6), as the
    reference shrinks its model before it averages.  With ``buckets``
    (``bucket, vector``) unknown words take part with sub-word vectors;
    words and buckets are then reduced by one common rotation.
    """
    articles = tx.dump_articles(dump)
    if buckets is None:
        if dimensions is not None:
            word_vectors = md.reduce_dimension(word_vectors, dimensions, id_col="word", vec_col="vector")
        return tx.text_vectors(articles, word_vectors, digits=digits)
    if dimensions is not None:
        key = lambda word, bucket: F.struct(word.alias("word"), bucket.cast("long").alias("bucket")).alias("key")
        rows = lambda df, k: df.select(k, F.col("vector").cast("array<double>").alias("vector"))
        both = rows(word_vectors, key(F.col("word"), F.lit(None))).unionByName(
            rows(buckets, key(F.lit(None).cast("string"), F.col("bucket"))))
        reduced = stored(md.reduce_dimension(both, dimensions, id_col="key", vec_col="vector"), "reduced")
        word_vectors = reduced.where("key.word is not null").select("key.word", "vector")
        buckets = reduced.where("key.bucket is not null").select("key.bucket", "vector")
    return sw.text_vectors_subwords(articles, word_vectors, buckets, n_buckets, digits=digits)


def search_ranks(pairs: DataFrame, docs: DataFrame, pages: DataFrame, k: int = nb.DEFAULT_K) -> DataFrame:
    """Pairs with the rank of their target among the text neighbours of their source (K3-K5).

    The source's title is looked up first: a source that is no page of
    ``pages`` has no neighbours, and only those pages are candidates.  Ranks
    are counted, so no neighbour list is made for them.
    """
    titled = nb.titled_ids(pairs, pages, "src").withColumnRenamed("page_id", "src")
    ranks = nb.target_positions(pairs.join(titled, "src", "left_semi"), docs, k, candidates=pages.select("page_id"))
    return ev.target_ranks(pairs, ranks.withColumnRenamed("trg", "nn"))


def text_search_evaluation(sessions: DataFrame, docs: DataFrame, pages: DataFrame, k: int = nb.DEFAULT_K, seed=None,
                           n_max: int | None = None, by_split: bool = True) -> DataFrame:
    """Evaluate text neighbours (more like this) on next-page pairs of sessions (K7)."""
    pairs = ev.limit_pairs(ev.query_pairs(sessions, seed), n_max)
    ranks = search_ranks(pairs, docs, pages, k)
    return ev.metrics_by_split(ranks) if by_split else ev.next_page_metrics(ranks)


def line_evaluation(inputs: Mapping[str, DataFrame], docs: DataFrame, pages: DataFrame, k: int = nb.DEFAULT_K, seed=None,
                    n_max: int | None = None) -> DataFrame:
    """The evaluation as it runs on session text files, one per input such as dev and test (A5, K1-K7).

    ``inputs`` maps a name to lines as ``read_session_lines`` gives them;
    ``n_max`` pairs of each, by line and number.  Neighbours are searched
    once for the sources of all inputs.  Returns ``input, n, mrr, ...``.
    """
    pairs = None
    for name, lines in inputs.items():
        part = ev.limit_pairs(ev.pairs_from_lines(lines, seed), n_max, order=("line", "copy")).withColumn("input", F.lit(name))
        pairs = part if pairs is None else pairs.union(part)
    ranks = search_ranks(stored(pairs, "line-pairs"), docs, pages, k)
    return ranks.groupBy("input").agg(*ev.metric_columns("rank"))
