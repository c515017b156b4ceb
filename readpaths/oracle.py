"""Independent SQL (DuckDB dialect) for each registered query.

Each statement recomputes its result from the base tables with plain SQL
(window functions, ``QUALIFY``, ``string_agg``), without sharing code with
the Spark operators, so an agreement of the two is a real check.  The
fixture views are the same rules as ``readpaths.sources.fixtures``.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixtures
PAGEVIEWS = """
pageviews AS (
  SELECT
    CAST(user_id AS VARCHAR) AS actor,
    CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
    event_id % 10 <> 0 AS is_pageview,
    CASE WHEN event_id % 7 = 0 THEN 'spider' ELSE 'user' END AS agent_type,
    CASE WHEN event_type = 'click' THEN 'desktop'
         WHEN event_type = 'signup' THEN 'mobile app'
         WHEN event_type = 'error' THEN NULL
         ELSE 'mobile web' END AS access_method,
    CASE WHEN event_id % 13 = 0 THEN 'wiktionary' ELSE 'wikipedia' END AS project_family,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 0 THEN 'simple' ELSE 'en' END AS project,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 9 THEN 1 ELSE 0 END AS namespace_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id,
    CASE WHEN event_id % 50 = 1 THEN NULL ELSE ts END AS ts,
    'page_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS page_title
  FROM events
)"""

RAW_VIEWS = """
raw_views AS (
  SELECT actor, ts, page_id, page_title, project || 'wiki' AS wiki_db, CAST(NULL AS VARCHAR) AS qid
  FROM pageviews
)"""

ITEM_LINKS = """
item_links AS (
  SELECT CASE WHEN o_custkey % 4 = 0 THEN 'simplewiki' ELSE 'enwiki' END AS wiki_db,
         o_custkey AS page_id,
         strftime(o_orderdate, '%Y-%m-%d') AS snapshot,
         'Q' || CAST(o_orderkey AS VARCHAR) AS item_id
  FROM orders
)"""

GRAPH_TABLES = """
page_t AS (
  SELECT CASE WHEN p_partkey % 50 = 49 THEN 'simplewiki' ELSE 'enwiki' END AS wiki_db,
         '2020-07' AS snapshot, p_partkey AS page_id, 'page_' || CAST(p_partkey AS VARCHAR) AS page_title,
         CASE WHEN p_partkey % 20 = 19 THEN 1 ELSE 0 END AS page_namespace,
         p_partkey % 7 = 3 AS page_is_redirect
  FROM part
),
redirect_t AS (
  SELECT CASE WHEN p_partkey % 50 = 49 THEN 'simplewiki' ELSE 'enwiki' END AS wiki_db,
         '2020-07' AS snapshot, p_partkey AS rd_from,
         'page_' || CAST((p_partkey * 13 + 5) % 3000 AS VARCHAR) AS rd_title,
         CASE WHEN p_partkey % 11 = 10 THEN 1 ELSE 0 END AS rd_namespace
  FROM part WHERE p_partkey % 7 = 3
),
pagelinks_t AS (
  SELECT CASE WHEN l_partkey % 50 = 49 THEN 'simplewiki' ELSE 'enwiki' END AS wiki_db,
         '2020-07' AS snapshot, l_partkey AS pl_from,
         'page_' || CAST(l_orderkey % 2500 AS VARCHAR) AS pl_title,
         CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS pl_from_namespace,
         CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS pl_namespace
  FROM lineitem
)"""


def md5int(expr: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# ------------------------------------------------------------ sessions
SEQ_ORDER = "ts NULLS FIRST, page_id NULLS FIRST, page_title NULLS FIRST, wiki_db NULLS FIRST, qid NULLS FIRST"


def ts_lit(value: str) -> str:
    return f"TIMESTAMP '{value} 00:00:00'" if len(value) == 10 else f"TIMESTAMP '{value}'"


def flat_pageviews_cte(name: str = "flat_pv") -> str:
    return f"""
{name} AS (
  SELECT actor, year, month, day, hour, is_pageview, agent_type, access_method, project_family, project,
         namespace_id, page_id, ts, page_title
  FROM pageviews
)"""


def hour_range_cte(src: str, start: str, end: str, name: str = "in_range") -> str:
    hour = "make_timestamp(year, month, day, hour, 0, 0.0)"
    return f"""
{name} AS (
  SELECT * FROM {src} WHERE {hour} >= {ts_lit(start)} AND {hour} < {ts_lit(end)}
)"""


def pageview_filter_cte(src: str, wiki_db: str | None, name: str = "filtered") -> str:
    wiki = f"AND project || 'wiki' = '{wiki_db}'" if wiki_db else ""
    return f"""
{name} AS (
  SELECT actor, year, month, day, hour, ts, page_id, page_title, project || 'wiki' AS wiki_db
  FROM {src}
  WHERE is_pageview AND agent_type = 'user' AND access_method <> 'mobile app'
    AND project_family = 'wikipedia' AND namespace_id = 0 {wiki}
)"""


def daily_cte(src: str, n_min: int, n_max: int, name: str = "daily") -> str:
    return f"""
{name} AS (
  SELECT * FROM {src}
  QUALIFY count(*) OVER (PARTITION BY actor, year, month, day) BETWEEN {n_min} AND {n_max}
)"""


def links_since_cte(since: str, wiki_db: str | None, name: str = "links_since") -> str:
    wiki = f"AND wiki_db = '{wiki_db}'" if wiki_db else ""
    return f"""
{name} AS (
  SELECT * FROM item_links WHERE snapshot >= '{since}' AND suffix(wiki_db, 'wiki') {wiki}
)"""


def latest_cte(src: str = "links_since", name: str = "latest") -> str:
    return f"""
{name} AS (
  SELECT wiki_db, page_id, item_id FROM {src}
  QUALIFY row_number() OVER (PARTITION BY wiki_db, page_id ORDER BY snapshot DESC, item_id DESC NULLS LAST) = 1
)"""


def joined_cte(views: str = "daily", items: str = "latest", name: str = "joined") -> str:
    return f"""
{name} AS (
  SELECT v.actor, v.ts, v.page_id, v.page_title, v.wiki_db, i.item_id AS qid
  FROM {views} v JOIN {items} i ON v.page_id = i.page_id AND v.wiki_db = i.wiki_db
)"""


def blacklist_cte(src: str, blacklist_sql: str, name: str = "kept") -> str:
    return f"""
{name}_clean AS (SELECT * FROM {src} WHERE ts IS NOT NULL AND page_id IS NOT NULL),
{name} AS (
  SELECT * FROM {name}_clean c
  WHERE NOT EXISTS (SELECT 1 FROM {name}_clean b
                    WHERE b.actor IS NOT DISTINCT FROM c.actor AND b.qid IN ({blacklist_sql}))
)"""


def first_visits_cte(src: str, name: str = "firsts", keys: str = "page_id") -> str:
    return f"""
{name} AS (
  SELECT actor, ts, page_id, page_title, wiki_db, qid FROM {src}
  WHERE ts IS NOT NULL AND page_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY actor, {keys} ORDER BY {SEQ_ORDER}) = 1
)"""


def split_cte(src: str, dt_seconds: int, name: str = "split") -> str:
    return f"""
{name}_gaps AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL
                  OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {int(dt_seconds) * 1_000_000}
             THEN 1 ELSE 0 END AS is_start
  FROM {src}
  WINDOW w AS (PARTITION BY actor ORDER BY {SEQ_ORDER})
),
{name} AS (
  SELECT *, CAST(sum(is_start) OVER (PARTITION BY actor ORDER BY {SEQ_ORDER}
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS session_no
  FROM {name}_gaps
)"""


def lines_cte(src: str, min_len: int, max_len: int, name: str = "lines") -> str:
    return f"""
{name} AS (
  SELECT actor, session_no, CAST(count(*) AS INTEGER) AS n_views,
         string_agg(CAST(page_id AS VARCHAR), ' ' ORDER BY {SEQ_ORDER}) AS line
  FROM {src}
  GROUP BY actor, session_no
  HAVING count(*) BETWEEN {min_len} AND {max_len}
)"""


def minimum_slice_sql(dt_seconds: int = 3600, min_len: int = 2, max_len: int = 30) -> str:
    """Clean -> first visits -> gap split -> length window -> lines on raw views."""
    return with_(PAGEVIEWS, RAW_VIEWS, first_visits_cte("raw_views"),
                 split_cte("firsts", dt_seconds), lines_cte("split", min_len, max_len)) + """
SELECT actor, session_no, n_views, line FROM lines"""


def session_chain(p, wiki_db: str | None) -> list[str]:
    """CTEs from the page views to ``lines`` for the test parameters ``p``."""
    keys = "page_id" if wiki_db else "wiki_db, page_id"
    bl = f"SELECT item_id FROM bl_latest WHERE wiki_db = '{p.blacklist_wiki}' AND page_id = {p.blacklist_page}"
    return [
        PAGEVIEWS, flat_pageviews_cte(), hour_range_cte("flat_pv", p.start, p.end),
        pageview_filter_cte("in_range", wiki_db), daily_cte("filtered", *p.n_p),
        ITEM_LINKS, links_since_cte(p.item_since, wiki_db), latest_cte(),
        links_since_cte(p.item_since, None, "bl_links"), latest_cte("bl_links", "bl_latest"),
        joined_cte(), blacklist_cte("joined", bl), first_visits_cte("kept", keys=keys),
        split_cte("firsts", p.dt), lines_cte("split", *p.length),
    ]


def pairs_cte(seed: str, src: str = "lines", name: str = "pairs") -> str:
    key = f"coalesce(actor, '') || '|' || CAST(session_no AS VARCHAR) || '|' || '{seed}'"
    idx = f"({md5int(key)} % (n_views - 1))"
    return f"""
{name}_idx AS (
  SELECT actor, session_no, string_split(line, ' ') AS ids, {idx} AS i FROM {src} WHERE n_views >= 2
),
{name} AS (
  SELECT actor, session_no, CAST(ids[i + 1] AS BIGINT) AS src, CAST(ids[i + 2] AS BIGINT) AS trg FROM {name}_idx
)"""


def line_pairs_cte(seed: str, src: str, name: str = "line_pairs") -> str:
    """One pair per text line of ``src`` (a query for ``line``), equal lines numbered."""
    return f"""
{name}_n AS (
  SELECT line, row_number() OVER (PARTITION BY line) AS copy, string_split(line, ' ') AS ids FROM ({src})
),
{name}_i AS (
  SELECT *, {md5int(f"line || '|' || CAST(copy AS VARCHAR) || '|{seed}'")} % (len(ids) - 1) AS i FROM {name}_n WHERE len(ids) >= 2
),
{name} AS (
  SELECT line, copy, CAST(ids[i + 1] AS BIGINT) AS src, CAST(ids[i + 2] AS BIGINT) AS trg FROM {name}_i
)"""


# ------------------------------------------------------------ graph
def graph_ctes(wiki_db: str, snapshot: str) -> list[str]:
    """CTEs ``g_pages, g_rd, g_content, g_links, g_edges, g_endpoints`` of one wiki snapshot."""
    sel = f"wiki_db = '{wiki_db}' AND snapshot = '{snapshot}'"
    return [GRAPH_TABLES, f"""
g_pages AS (
  SELECT page_id, page_title, page_is_redirect FROM page_t WHERE {sel} AND page_namespace = 0
),
g_rd AS (
  SELECT r.rd_from, p.page_id AS rd_to
  FROM redirect_t r JOIN g_pages p ON p.page_title = r.rd_title
  WHERE r.{sel.replace(" AND snapshot", " AND r.snapshot")} AND r.rd_namespace = 0
),
g_content AS (
  SELECT pl_from AS page_id_from, pl_title AS page_title FROM pagelinks_t l
  WHERE {sel} AND pl_from_namespace = 0 AND pl_namespace = 0
    AND NOT EXISTS (SELECT 1 FROM g_rd r WHERE r.rd_from = l.pl_from)
),
g_links AS (
  SELECT c.page_id_from, p.page_id AS page_id_to FROM g_content c JOIN g_pages p ON p.page_title = c.page_title
),
g_edges AS (
  SELECT DISTINCT l.page_id_from, coalesce(r.rd_to, l.page_id_to) AS page_id_to
  FROM g_links l LEFT JOIN g_rd r ON l.page_id_to = r.rd_from
),
g_endpoints AS (
  SELECT page_id_from AS page_id FROM g_edges UNION SELECT page_id_to AS page_id FROM g_edges
)"""]


def chain_ctes(max_hops: int | None) -> list[str]:
    """CTE ``g_chains``: the end of every redirect's chain, walked one hop a step; walks that meet a page again are cycles."""
    return [f"""
g_walk AS (
  SELECT rd_from, rd_to, 1 AS hops, [rd_from] AS seen, rd_to = rd_from AS again FROM g_rd
  UNION ALL
  SELECT w.rd_from, r.rd_to, w.hops + 1, list_append(w.seen, r.rd_from), list_contains(w.seen, r.rd_to) OR r.rd_to = r.rd_from
  FROM g_walk w JOIN g_rd r ON r.rd_from = w.rd_to WHERE NOT w.again
),
g_cycles AS (SELECT DISTINCT rd_from FROM g_walk WHERE again),
g_chains AS (
  SELECT w.rd_from, w.rd_to, false AS in_cycle FROM g_walk w
  WHERE w.rd_from NOT IN (SELECT rd_from FROM g_cycles) AND {f"w.hops <= {max_hops}" if max_hops else "true"}
  QUALIFY row_number() OVER (PARTITION BY w.rd_from ORDER BY w.hops DESC) = 1
  UNION ALL
  SELECT rd_from, rd_to, true FROM g_rd WHERE rd_from IN (SELECT rd_from FROM g_cycles)
)"""]


# ------------------------------------------------------------ text
DUMP_ARTICLES = r"""
SELECT page_id, 'page_' || page_id AS page_title,
  trim('P' || page_id || ' is label ' || page_id || ' é©é given site' ||
    CASE page_id % 5 WHEN 0 THEN ' {{ open' WHEN 1 THEN ' [[ open' WHEN 2 THEN ' {| open' ELSE '' END || ' See ' ||
    regexp_replace(coalesce(url, '') || ' there.', '\s+', ' ', 'g')) AS text
FROM pages WHERE page_id % 10 <> 9 AND page_id % 7 <> 3"""

INLINE = ("a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|time|u|var|wbr")
LEAD = rf"""
lead AS (
  SELECT page_id,
         trim(regexp_replace(regexp_replace(regexp_replace(
           regexp_extract(html, '(?s)<article>(.*?)(<h2|</article>)', 1),
           '(?i)</?(?:{INLINE})(?:\s[^>]*)?/?>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages
)"""


def word_count_cte(src: str, id_col: str, text_col: str, name: str) -> str:
    return rf"""
{name}_tok AS (
  SELECT {id_col} AS page_id, unnest(regexp_split_to_array(lower({text_col}), '[^\p{{L}}\p{{N}}]+')) AS word FROM {src}
),
{name} AS (
  SELECT page_id, word, count(*) AS n FROM {name}_tok WHERE length(word) >= 1 GROUP BY page_id, word
)"""


def text_vector_ctes(src: str = "lead", name: str = "tvec", rounded: bool = True) -> list[str]:
    val = "round(sum(c.n * u.x) / sum(c.n), 6)" if rounded else "sum(c.n * u.x) / sum(c.n)"
    return [word_count_cte(src, "page_id", "text", f"{name}_counts"), f"""
{name}_vocab AS (
  SELECT DISTINCT word FROM {name}_counts
),
{name}_wv AS (
  SELECT v.word, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM {name}_vocab v JOIN embeddings e ON e.vec_id = {md5int('v.word')} % (SELECT count(*) FROM embeddings)
),
{name}_dims AS (
  SELECT word, unnest(generate_series(1, len(vector))) AS dim, unnest(vector) AS x FROM {name}_wv
),
{name}_unit AS (
  SELECT word, dim, x / sqrt(sum(x * x) OVER (PARTITION BY word)) AS x
  FROM {name}_dims
  QUALIFY sum(x * x) OVER (PARTITION BY word) > 0
),
{name}_mean AS (
  SELECT c.page_id, u.dim, {val} AS m
  FROM {name}_counts c JOIN {name}_unit u ON u.word = c.word
  GROUP BY c.page_id, u.dim
),
{name}_known AS (
  SELECT page_id, list(m ORDER BY dim) AS vector FROM {name}_mean GROUP BY page_id
),
{name} AS (
  SELECT t.page_id, coalesce(k.vector, list_resize(CAST([] AS DOUBLE[]), (SELECT max(len(embedding)) FROM embeddings), 0.0)) AS vector
  FROM {src} t LEFT JOIN {name}_known k ON k.page_id = t.page_id
)"""]


def subword_ctes(min_n: int, max_n: int, src: str = "lead", name: str = "sub") -> list[str]:
    """Vectors of the unknown words of ``src`` from their n-grams, and page vectors with them."""
    digit = "(strpos('0123456789ABCDEF', substr(hex(gram), {}, 1)) - 1)"
    octet = f"(16 * {digit.format('2 * i + 1')} + {digit.format('2 * i + 2')})"
    signed = f"CAST({octet} + CASE WHEN {octet} >= 128 THEN 4294967040 ELSE 0 END AS BIGINT)"
    return [word_count_cte(src, "page_id", "text", f"{name}_counts"), f"""
{name}_words AS (SELECT DISTINCT word FROM {name}_counts),
{name}_grams AS (
  SELECT word, unnest(flatten(list_transform(range({min_n}, {max_n + 1}), lambda n:
    list_transform(range(1, length(word) + 4 - n), lambda p: substr('<' || word || '>', p, n))))) AS gram
  FROM {name}_words WHERE {md5int('word')} % 3 = 0
),
{name}_hashes AS (
  SELECT gram, list_reduce(list_prepend(CAST(2166136261 AS BIGINT),
    list_transform(range(0, strlen(gram)), lambda i: {signed})), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h
  FROM (SELECT DISTINCT gram FROM {name}_grams)
),
{name}_gram_dims AS (
  SELECT g.word, unnest(generate_series(1, len(e.embedding))) AS dim, unnest(CAST(e.embedding AS DOUBLE[])) AS x
  FROM {name}_grams g JOIN {name}_hashes s ON s.gram = g.gram
  JOIN embeddings e ON e.vec_id = s.h % (SELECT count(*) FROM embeddings)
),
{name}_unknown AS (SELECT word, dim, avg(x) AS x FROM {name}_gram_dims GROUP BY word, dim),
{name}_vectors AS (SELECT word, list(round(x, 6) ORDER BY dim) AS vector FROM {name}_unknown GROUP BY word),
{name}_dims AS (
  SELECT word, dim, x FROM {name}_unknown
  UNION ALL
  SELECT v.word, unnest(generate_series(1, len(e.embedding))), unnest(CAST(e.embedding AS DOUBLE[]))
  FROM {name}_words v JOIN embeddings e ON e.vec_id = {md5int('v.word')} % (SELECT count(*) FROM embeddings)
  WHERE {md5int('v.word')} % 3 <> 0
),
{name}_unit AS (
  SELECT word, dim, x / sqrt(sum(x * x) OVER (PARTITION BY word)) AS x
  FROM {name}_dims QUALIFY sum(x * x) OVER (PARTITION BY word) > 0
),
{name}_mean AS (
  SELECT c.page_id, u.dim, round(sum(c.n * u.x) / sum(c.n), 6) AS m
  FROM {name}_counts c JOIN {name}_unit u ON u.word = c.word GROUP BY c.page_id, u.dim
),
{name}_known AS (SELECT page_id, list(m ORDER BY dim) AS vector FROM {name}_mean GROUP BY page_id),
{name}_pages AS (
  SELECT t.page_id, coalesce(k.vector, list_resize(CAST([] AS DOUBLE[]), (SELECT max(len(embedding)) FROM embeddings), 0.0)) AS vector
  FROM {src} t LEFT JOIN {name}_known k ON k.page_id = t.page_id
)"""]


def mlt_ctes(k: int, sources_sql: str | None = None, candidates_sql: str | None = None, name: str = "mlt") -> list[str]:
    src_filter = f"WHERE doc_id IN ({sources_sql})" if sources_sql else ""
    nn_filter = f"AND p.doc_id IN ({candidates_sql})" if candidates_sql else ""
    return [word_count_cte("documents", "doc_id", "text", f"{name}_counts"), f"""
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs FROM documents),
{name}_df AS (SELECT word, count(*) AS df FROM {name}_counts GROUP BY word),
{name}_w0 AS (
  SELECT c.page_id AS doc_id, c.word AS term, round(c.n * ln(n.n_docs / d.df), 9) AS weight
  FROM {name}_counts c JOIN {name}_df d ON d.word = c.word CROSS JOIN {name}_n n
),
{name}_w AS (SELECT * FROM {name}_w0 WHERE weight > 0),
{name}_q AS (
  SELECT doc_id AS src, term, weight AS w_src FROM {name}_w {src_filter}
),
{name}_scored AS (
  SELECT q.src, p.doc_id AS nn, round(sum(q.w_src * p.weight), 6) AS score
  FROM {name}_q q JOIN {name}_w p ON p.term = q.term
  WHERE p.doc_id <> q.src {nn_filter}
  GROUP BY q.src, p.doc_id
),
{name} AS (
  SELECT src, nn, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, nn) AS INTEGER) AS rank
  FROM {name}_scored
  QUALIFY rank <= {k}
)"""]


def vector_nn_ctes(k: int, sources_sql: str | None = None, name: str = "vnn") -> list[str]:
    src_filter = f"WHERE a.page_id IN ({sources_sql})" if sources_sql else ""
    return [f"""
{name}_u AS (
  SELECT vec_id AS page_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
{name}_unit AS (
  SELECT page_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
  FROM {name}_u WHERE list_sum(list_transform(v, lambda y: y * y)) > 0
),
{name}_pairs AS (
  SELECT a.page_id AS src, b.page_id AS nn,
         round(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])), 9) AS score
  FROM {name}_unit a JOIN {name}_unit b ON a.page_id <> b.page_id {src_filter}
),
{name} AS (
  SELECT src, nn, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, nn) AS INTEGER) AS rank
  FROM {name}_pairs
  QUALIFY rank <= {k}
)"""]
