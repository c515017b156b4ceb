"""Registered queries: one per operator of the inventory, over the test tables.

``queries()`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
gives the same result as DuckDB SQL over the base tables.  Every query
reads whole tables -- no id subsets, no row caps; the only limit is the
one of ``query_pairs_limited``, where the limit is the feature (G2).

Test parameters are those of the fixture description: time range
``[2024-01-03, 2024-01-25)``, 1-3 views per actor-day, 6-hour gap,
sessions of 2-30 views, blacklist = latest item of page 42, items since
``2000-01-01``, graph of ``enwiki`` at ``2020-07``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths import oracle as O
from readpaths.operators import evaluate as ev
from readpaths.operators import filters as flt
from readpaths.operators import graph as gr
from readpaths.operators import items as it
from readpaths.operators import neighbors as nb
from readpaths.operators import sessions as ss
from readpaths.operators import subwords as sw
from readpaths.operators import text as tx
from readpaths.operators import vector_hashing as vh
from readpaths.operators import vectors as vn
from readpaths.plans import jobs
from readpaths.session import checkpoint_dir, ensure_conf, stored
from readpaths.sinks import writers as wr
from readpaths.sources import fixtures as fx
from readpaths.sources import tables as tb


@dataclass(frozen=True)
class TestParams:
    start: str = "2024-01-03"
    end: str = "2024-01-25"
    n_p: tuple[int, int] = (1, 3)
    dt: int = 21600
    length: tuple[int, int] = (2, 30)
    item_since: str = "2000-01-01"
    wiki: str = "enwiki"
    blacklist_wiki: str = "enwiki"
    blacklist_page: int = 42
    graph_wiki: str = "enwiki"
    graph_snapshot: str = "2020-07"
    seed: str = "1"
    k: int = 100
    n_pairs: int = 50
    slice_dt: int = 3600
    max_hops: int = 3


P = TestParams()


# ------------------------------------------------------------------ helpers
def flat_pageviews(df: DataFrame) -> DataFrame:
    """Page views with the struct and map flattened (for comparison only)."""
    return df.select("actor", "year", "month", "day", "hour", "is_pageview", "agent_type", "access_method",
                     F.col("normalized_host.project_family").alias("project_family"),
                     F.col("normalized_host.project").alias("project"),
                     "namespace_id", "page_id", "ts",
                     F.col("pageview_info")["page_title"].alias("page_title"))


def _filtered(spark, d, wiki=None):
    pv = flt.hour_range_filter(fx.pageviews(spark, d), P.start, P.end)
    return flt.pageview_filters(pv, wiki)


def _daily(spark, d, wiki=None):
    return flt.daily_volume_filter(_filtered(spark, d, wiki), *P.n_p)


def _flat_filtered(df):
    return df.select("actor", "year", "month", "day", "hour", "ts", "page_id",
                     F.col("pageview_info")["page_title"].alias("page_title"), "wiki_db")


def _latest(spark, d, wiki=None):
    return it.latest_item(fx.item_links(spark, d), P.item_since, wiki)


def _blacklist(spark, d):
    bl = _latest(spark, d, None)
    return bl.where((F.col("wiki_db") == P.blacklist_wiki) & (F.col("page_id") == P.blacklist_page)).select(
        F.col("item_id").alias("qid"))


def _joined(spark, d, wiki, blacklist=None):
    return jobs.session_views(fx.pageviews(spark, d), fx.item_links(spark, d), P.start, P.end, wiki, *P.n_p, P.item_since, blacklist=blacklist)


def _sessions(spark, d, wiki=P.wiki):
    return ss.reading_sessions(_joined(spark, d, wiki, _blacklist(spark, d)), P.dt, *P.length,
                               dedupe_keys=jobs.dedupe_keys_for(wiki))


def _lines(df):
    return df.select("actor", "session_no", "n_views", "line")


def _pairs(spark, d):
    return ev.query_pairs(_sessions(spark, d), P.seed)


def _ranks(spark, d):
    return jobs.search_ranks(_pairs(spark, d), fx.documents(spark, d), _graph_pages(spark, d), P.k)


def _line_files(spark, d):
    """Session lines of the dev and test actors, written as two text files and read back (B2, A5)."""
    sessions = stored(_sessions(spark, d).withColumn("split", ev.split_of("actor")), "sessions")
    out = {}
    for name in ("dev", "test"):
        path = checkpoint_dir(spark, f"session-lines-{name}")
        wr.write_lines(sessions.where(F.col("split") == name), path)
        out[name] = tb.read_session_lines(spark, path)
    return out


def _graph_pages(spark, d):
    return gr.main_namespace_pages(fx.page_table(spark, d), P.graph_wiki, P.graph_snapshot)


def _graph_rd(spark, d):
    return gr.redirect_map(fx.redirect_table(spark, d), _graph_pages(spark, d), P.graph_wiki, P.graph_snapshot)


def _graph_edges(spark, d):
    return gr.graph_edges(fx.page_table(spark, d), fx.redirect_table(spark, d), fx.pagelinks_table(spark, d),
                          P.graph_wiki, P.graph_snapshot)


def _lead(spark, d):
    return tx.lead_text(fx.page_html(spark, d))


def _text_vectors(spark, d, digits=6):
    lead = stored(_lead(spark, d), "leads")
    counts = stored(tx.word_counts(lead), "word_counts")
    wv = stored(fx.word_vectors_for(spark, d, counts), "word_vectors")
    return tx.text_vectors(lead, wv, digits=digits, counts=counts)


# ------------------------------------------------------------------ queries
def q_scan_pageviews(spark, d):
    return flat_pageviews(fx.pageviews(spark, d))


def q_clean_views(spark, d):
    return flt.clean_views(fx.raw_views(spark, d))


def q_first_visits(spark, d):
    return ss.first_visits(flt.clean_views(fx.raw_views(spark, d)))


def q_gap_sessions(spark, d):
    firsts = ss.first_visits(flt.clean_views(fx.raw_views(spark, d)))
    return ss.gap_sessions(firsts, P.slice_dt).select(*ss.SEQ_FIELDS, "actor", "session_no")


def q_session_lines(spark, d):
    return _lines(ss.reading_sessions(fx.raw_views(spark, d), P.slice_dt, *P.length, blacklist=None))


def q_hour_range_filter(spark, d):
    return flat_pageviews(flt.hour_range_filter(fx.pageviews(spark, d), P.start, P.end))


def q_pageview_filters(spark, d):
    return _flat_filtered(_filtered(spark, d))


def q_daily_volume_filter(spark, d):
    return _flat_filtered(_daily(spark, d))


def q_item_links_since(spark, d):
    return it.item_links_since(fx.item_links(spark, d), P.item_since)


def q_latest_item(spark, d):
    return _latest(spark, d)


def q_views_with_item(spark, d):
    return _joined(spark, d, None)


def q_actor_sequences(spark, d):
    days = (dt.date.fromisoformat(P.end) - dt.date.fromisoformat(P.start)).days
    seq = ss.actor_sequences(_joined(spark, d, P.wiki), max_views=P.n_p[1] * days)
    return seq.select("actor", F.size("session").alias("n_views"),
                      F.concat_ws(" ", F.transform("session", lambda e: e["page_id"].cast("string"))).alias("line"))


def q_blacklist_actors(spark, d):
    clean = flt.clean_views(_joined(spark, d, P.wiki))
    return ss.blacklist_actors(clean, _blacklist(spark, d))


def q_reading_sessions(spark, d):
    return _lines(_sessions(spark, d))


def q_sessions_all_wikis(spark, d):
    return _lines(_sessions(spark, d, None))


def q_session_lines_roundtrip(spark, d):
    path = checkpoint_dir(spark, "session-lines")
    wr.write_lines(_sessions(spark, d), path)
    back = tb.read_session_lines(spark, path)
    return back.select(F.col("value").alias("line"), F.size("page_ids").alias("n_views"))


def q_snapshot_select(spark, d):
    return gr.snapshot_select(fx.page_table(spark, d), P.graph_wiki, P.graph_snapshot)


def q_main_namespace_pages(spark, d):
    return _graph_pages(spark, d)


def q_redirect_map(spark, d):
    return _graph_rd(spark, d)


def q_redirect_chains(spark, d):
    return gr.redirect_chains(_graph_rd(spark, d))


def q_graph_edges_multi_hop(spark, d):
    return gr.graph_edges(fx.page_table(spark, d), fx.redirect_table(spark, d), fx.pagelinks_table(spark, d),
                          P.graph_wiki, P.graph_snapshot, max_hops=P.max_hops)


def q_links_from_content_pages(spark, d):
    return gr.links_from_content_pages(fx.pagelinks_table(spark, d), _graph_rd(spark, d), P.graph_wiki,
                                       P.graph_snapshot)


def q_links_by_id(spark, d):
    content = q_links_from_content_pages(spark, d)
    return gr.links_by_id(content, _graph_pages(spark, d))


def q_graph_edges(spark, d):
    return _graph_edges(spark, d)


def q_edge_endpoints(spark, d):
    return gr.edge_endpoints(_graph_edges(spark, d))


def q_graph_nodes(spark, d):
    items = _latest(spark, d, P.graph_wiki).select("page_id", "item_id")
    return gr.graph_nodes(_graph_pages(spark, d), gr.edge_endpoints(_graph_edges(spark, d)), items)


def q_title_lookup(spark, d):
    ids = _pairs(spark, d).select(F.col("src").alias("page_id")).distinct()
    return gr.title_lookup(ids, _graph_pages(spark, d))


def q_query_pairs(spark, d):
    return _pairs(spark, d)


def q_query_pairs_limited(spark, d):
    return ev.limit_pairs(_pairs(spark, d), P.n_pairs)


def q_vector_neighbors(spark, d):
    return vn.vector_neighbors(fx.page_vectors(spark, d), k=P.k)


def q_vector_neighbors_hashed(spark, d):
    """Buckets of 64 vectors, so that the test tables have several."""
    return vh.vector_neighbors_hashed(fx.page_vectors(spark, d), k=P.k, bucket=64)


def q_target_ranks(spark, d):
    return _ranks(spark, d)


def q_next_page_metrics(spark, d):
    return ev.next_page_metrics(_ranks(spark, d))


def q_metrics_by_split(spark, d):
    return ev.metrics_by_split(_ranks(spark, d))


def q_line_pairs(spark, d):
    files = _line_files(spark, d)
    return ev.pairs_from_lines(files["dev"].union(files["test"]), P.seed)


def q_line_metrics(spark, d):
    return jobs.line_evaluation(_line_files(spark, d), fx.documents(spark, d), _graph_pages(spark, d), P.k, P.seed)


def q_metrics_json(spark, d):
    return ev.metrics_json(ev.next_page_metrics(_ranks(spark, d)))


def q_vector_target_ranks(spark, d):
    pairs = _pairs(spark, d)
    neigh = vn.vector_neighbors(fx.page_vectors(spark, d), k=P.k, sources=pairs.select("src"))
    return ev.target_ranks(pairs, neigh)


def q_vector_metrics_by_split(spark, d):
    return ev.metrics_by_split(q_vector_target_ranks(spark, d))


def q_lead_text(spark, d):
    return _lead(spark, d)


def q_dump_articles(spark, d):
    return tx.dump_articles(fx.page_dump(spark, d))


def q_text_vectors(spark, d):
    return _text_vectors(spark, d)


def q_subword_vectors(spark, d):
    words = tx.word_counts(_lead(spark, d)).select("word").distinct()
    buckets = fx.bucket_vectors(spark, d)
    return sw.subword_vectors(sw.unknown_words(words, fx.known_word_vectors(spark, d, words)), buckets, buckets.count(), digits=6)


def q_text_vectors_subwords(spark, d):
    lead = _lead(spark, d)
    buckets = fx.bucket_vectors(spark, d)
    return sw.text_vectors_subwords(lead, fx.known_word_vectors(spark, d, tx.word_counts(lead)), buckets, buckets.count())


def q_vector_lines(spark, d):
    return _text_vectors(spark, d, digits=None).select(tx.vector_text_line().alias("line"))


def q_more_like_this(spark, d):
    return nb.more_like_this(fx.documents(spark, d), k=P.k)


def q_more_like_this_by_id(spark, d):
    ids = _pairs(spark, d).select(F.col("src").alias("page_id"))
    pages = gr.main_namespace_pages(fx.page_table(spark, d), P.graph_wiki, P.graph_snapshot)
    return nb.more_like_this_by_id(ids, pages, fx.documents(spark, d), k=P.k)


def q_reduced_vectors(spark, d):
    """Full-rank reduction: a rotation, so norms and the products with the first vector survive it."""
    from readpaths.operators import models

    emb = fx.page_vectors(spark, d)
    first = emb.orderBy("page_id").first()["vector"]
    reduced = models.reduce_dimension(emb, k=len(first))
    anchor = F.array(*[F.lit(x) for x in reduced.orderBy("page_id").first()["vector"]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return reduced.select("page_id", F.size("vector").alias("dimensions"), F.round(dot("vector", "vector"), 5).alias("square"),
                       F.round(dot("vector", anchor), 5).alias("product"))


def _with_conf(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Pin the session settings the operators rely on (UTC zone, AQE) before planning."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_conf(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: _with_conf(fn) for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}


# ------------------------------------------------------------------ oracle SQL
def _sql_sessions(wiki, select="SELECT actor, session_no, n_views, line FROM lines"):
    return O.with_(*O.session_chain(P, wiki)) + "\n" + select


TITLED = "SELECT p.src FROM {} p JOIN g_pages g ON g.page_id = p.src WHERE length(g.page_title) > 0"


def _sql_pairs(select):
    return O.with_(*O.session_chain(P, P.wiki), O.pairs_cte(P.seed)) + "\n" + select


def _sql_ranks(select):
    ctes = [*O.session_chain(P, P.wiki), O.pairs_cte(P.seed), *O.graph_ctes(P.graph_wiki, P.graph_snapshot),
            *O.mlt_ctes(P.k, TITLED.format("pairs"), "SELECT page_id FROM g_pages"),
            """
ranks AS (
  SELECT p.actor, p.session_no, p.src, p.trg, coalesce(CAST(m.rank AS DOUBLE), 1e6) AS rank
  FROM pairs p LEFT JOIN mlt m ON m.src = p.src AND m.nn = p.trg
)"""]
    return O.with_(*ctes) + "\n" + select


def _sql_vector_ranks(select):
    ctes = [*O.session_chain(P, P.wiki), O.pairs_cte(P.seed), *O.vector_nn_ctes(P.k, "SELECT src FROM pairs"),
            """
ranks AS (
  SELECT p.actor, p.session_no, p.src, p.trg, coalesce(CAST(m.rank AS DOUBLE), 1e6) AS rank
  FROM pairs p LEFT JOIN vnn m ON m.src = p.src AND m.nn = p.trg
)"""]
    return O.with_(*ctes) + "\n" + select


METRICS = """count(*) AS n, round(avg(1.0 / rank), 9) AS mrr,
  round(avg(CASE WHEN rank <= 1 AND rank <> 1e6 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_1,
  round(avg(CASE WHEN rank <= 10 AND rank <> 1e6 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_10,
  round(avg(CASE WHEN rank <= 50 AND rank <> 1e6 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_50,
  round(avg(CASE WHEN rank <= 100 AND rank <> 1e6 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_100"""

_ACTOR_KEY = "coalesce(actor, '')"
SPLIT = f"CASE WHEN {O.md5int(_ACTOR_KEY)} % 2 = 0 THEN 'dev' ELSE 'test' END"


def _graph(select, wiki=P.graph_wiki):
    return O.with_(*O.graph_ctes(wiki, P.graph_snapshot)) + "\n" + select


def _graph_chains(max_hops, select):
    return O.with_(*O.graph_ctes(P.graph_wiki, P.graph_snapshot), *O.chain_ctes(max_hops)).replace("WITH", "WITH RECURSIVE", 1) + "\n" + select


def _graph_items(select):
    ctes = [*O.graph_ctes(P.graph_wiki, P.graph_snapshot), O.ITEM_LINKS,
            O.links_since_cte(P.item_since, P.graph_wiki), O.latest_cte()]
    return O.with_(*ctes) + "\n" + select


SEQ_COLS = "actor, ts, page_id, page_title, wiki_db, qid"
FILTERED = [O.PAGEVIEWS, O.flat_pageviews_cte(), O.hour_range_cte("flat_pv", P.start, P.end),
            O.pageview_filter_cte("in_range", None)]

ORACLE: dict[str, str] = {
    "scan_pageviews": O.with_(O.PAGEVIEWS, O.flat_pageviews_cte()) + "\nSELECT * FROM flat_pv",
    "clean_views": O.with_(O.PAGEVIEWS, O.RAW_VIEWS)
    + "\nSELECT * FROM raw_views WHERE ts IS NOT NULL AND page_id IS NOT NULL",
    "first_visits": O.with_(O.PAGEVIEWS, O.RAW_VIEWS, O.first_visits_cte("raw_views")) + "\nSELECT * FROM firsts",
    "gap_sessions": O.with_(O.PAGEVIEWS, O.RAW_VIEWS, O.first_visits_cte("raw_views"),
                            O.split_cte("firsts", P.slice_dt)) + f"\nSELECT {SEQ_COLS}, session_no FROM split",
    "session_lines": O.minimum_slice_sql(P.slice_dt, *P.length),
    "hour_range_filter": O.with_(O.PAGEVIEWS, O.flat_pageviews_cte(), O.hour_range_cte("flat_pv", P.start, P.end))
    + "\nSELECT * FROM in_range",
    "pageview_filters": O.with_(*FILTERED) + "\nSELECT * FROM filtered",
    "daily_volume_filter": O.with_(*FILTERED, O.daily_cte("filtered", *P.n_p)) + "\nSELECT * FROM daily",
    "item_links_since": O.with_(O.ITEM_LINKS, O.links_since_cte(P.item_since, None)) + "\nSELECT * FROM links_since",
    "latest_item": O.with_(O.ITEM_LINKS, O.links_since_cte(P.item_since, None), O.latest_cte())
    + "\nSELECT * FROM latest",
    "views_with_item": O.with_(*FILTERED, O.daily_cte("filtered", *P.n_p), O.ITEM_LINKS,
                               O.links_since_cte(P.item_since, None), O.latest_cte(), O.joined_cte())
    + "\nSELECT * FROM joined",
    "blacklist_actors": _sql_sessions(P.wiki, "SELECT * FROM kept"),
    "actor_sequences": _sql_sessions(P.wiki, f"""SELECT actor, CAST(count(*) AS INTEGER) AS n_views,
  string_agg(CAST(page_id AS VARCHAR), ' ' ORDER BY {O.SEQ_ORDER}) AS line
FROM joined GROUP BY actor"""),
    "reading_sessions": _sql_sessions(P.wiki),
    "sessions_all_wikis": _sql_sessions(None),
    "session_lines_roundtrip": _sql_sessions(P.wiki, "SELECT line, n_views FROM lines"),
    "snapshot_select": O.with_(O.GRAPH_TABLES)
    + f"\nSELECT * FROM page_t WHERE wiki_db = '{P.graph_wiki}' AND snapshot = '{P.graph_snapshot}'",
    "main_namespace_pages": _graph("SELECT * FROM g_pages"),
    "redirect_map": _graph("SELECT * FROM g_rd"),
    "redirect_chains": _graph_chains(None, "SELECT rd_from, rd_to, in_cycle FROM g_chains"),
    "graph_edges_multi_hop": _graph_chains(P.max_hops, """SELECT DISTINCT l.page_id_from, coalesce(r.rd_to, l.page_id_to) AS page_id_to
FROM g_links l LEFT JOIN g_chains r ON l.page_id_to = r.rd_from"""),
    "links_from_content_pages": _graph("SELECT * FROM g_content"),
    "links_by_id": _graph("SELECT * FROM g_links"),
    "graph_edges": _graph("SELECT * FROM g_edges"),
    "edge_endpoints": _graph("SELECT * FROM g_endpoints"),
    "graph_nodes": _graph_items("""SELECT p.page_id, p.page_title, i.item_id
FROM g_pages p LEFT JOIN latest i ON i.page_id = p.page_id
WHERE p.page_id IN (SELECT page_id FROM g_endpoints)"""),
    "query_pairs": _sql_pairs("SELECT * FROM pairs"),
    "title_lookup": O.with_(*O.session_chain(P, P.wiki), O.pairs_cte(P.seed),
                            *O.graph_ctes(P.graph_wiki, P.graph_snapshot)) + """
SELECT s.page_id, coalesce(g.page_title, '') AS page_title
FROM (SELECT DISTINCT src AS page_id FROM pairs) s LEFT JOIN g_pages g ON g.page_id = s.page_id""",
    "query_pairs_limited": _sql_pairs(f"SELECT * FROM pairs ORDER BY actor, session_no LIMIT {P.n_pairs}"),
    "vector_neighbors": O.with_(*O.vector_nn_ctes(P.k)) + "\nSELECT * FROM vnn",
    "target_ranks": _sql_ranks("SELECT * FROM ranks"),
    "next_page_metrics": _sql_ranks(f"SELECT {METRICS} FROM ranks"),
    "metrics_by_split": _sql_ranks(f"SELECT {SPLIT} AS split, {METRICS} FROM ranks GROUP BY 1"),
    "metrics_json": _sql_ranks(f"""SELECT to_json({{'N': n, 'MRR': mrr, 'Recall@1': recall_at_1,
  'Recall@10': recall_at_10, 'Recall@50': recall_at_50, 'Recall@100': recall_at_100}}) AS json
FROM (SELECT {METRICS} FROM ranks)"""),
    "vector_target_ranks": _sql_vector_ranks("SELECT * FROM ranks"),
    "vector_metrics_by_split": _sql_vector_ranks(f"SELECT {SPLIT} AS split, {METRICS} FROM ranks GROUP BY 1"),
    "lead_text": O.with_(O.LEAD) + "\nSELECT * FROM lead",
    "dump_articles": O.DUMP_ARTICLES,
    "text_vectors": O.with_(O.LEAD, *O.text_vector_ctes()) + "\nSELECT * FROM tvec",
    "subword_vectors": O.with_(O.LEAD, *O.subword_ctes(sw.MIN_N, sw.MAX_N)) + "\nSELECT word, vector FROM sub_vectors",
    "text_vectors_subwords": O.with_(O.LEAD, *O.subword_ctes(sw.MIN_N, sw.MAX_N)) + "\nSELECT page_id, vector FROM sub_pages",
    "vector_lines": O.with_(O.LEAD, *O.text_vector_ctes(rounded=False)) + """
SELECT CAST(page_id AS VARCHAR) || ' ' || array_to_string(list_transform(vector, lambda x: printf('%.5f', x)), ' ') AS line
FROM tvec""",
    "more_like_this": O.with_(*O.mlt_ctes(P.k)) + "\nSELECT * FROM mlt",
    "more_like_this_by_id": O.with_(*O.session_chain(P, P.wiki), O.pairs_cte(P.seed),
                                    *O.graph_ctes(P.graph_wiki, P.graph_snapshot),
                                    *O.mlt_ctes(P.k, TITLED.format("pairs"), "SELECT page_id FROM g_pages")) + "\nSELECT * FROM mlt",
    "line_pairs": O.with_(*O.session_chain(P, P.wiki), O.line_pairs_cte(P.seed, "SELECT line FROM lines"))
    + "\nSELECT * FROM line_pairs",
    "line_metrics": O.with_(
        *O.session_chain(P, P.wiki),
        *(O.line_pairs_cte(P.seed, f"SELECT line FROM lines WHERE {SPLIT} = '{x}'", x) for x in ("dev", "test")),
        "both_pairs AS (SELECT 'dev' AS input, src, trg FROM dev UNION ALL SELECT 'test', src, trg FROM test)",
        *O.graph_ctes(P.graph_wiki, P.graph_snapshot), *O.mlt_ctes(P.k, TITLED.format("both_pairs"), "SELECT page_id FROM g_pages"),
        "ranks AS (SELECT p.input, coalesce(CAST(m.rank AS DOUBLE), 1e6) AS rank "
        "FROM both_pairs p LEFT JOIN mlt m ON m.src = p.src AND m.nn = p.trg)")
    + f"\nSELECT input, {METRICS} FROM ranks GROUP BY 1",
    "reduced_vectors": """
SELECT e.vec_id AS page_id, CAST(len(e.embedding) AS INTEGER) AS dimensions,
  round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5) AS square,
  round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 5) AS product
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) f""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
