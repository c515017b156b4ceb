"""Views over the driver's test tables in the shapes the jobs read.

The production inputs are a page-view table, an item-link table, page /
redirect / page-link tables, page text and word vectors.  The test data
ships TPC-H-like tables instead, so each shape is derived from one of
them by a fixed, deterministic rule.  The rules are fixed values: they
must stay exactly as written so the SQL oracle computes the same views.

All views are lazy projections of one parquet scan each: no shuffle, and
column pruning / filter pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths.functions.columns import md5int
from readpaths.sources.tables import spread

# Fixed values of the fixture rules (FIXTURES.md):
#   page id carried in events.props as JSON field "k"
#   word -> vector row:  vec_id = md5int(word) % (rows of embeddings)
SCAN_TASKS = 16  # the test files have one row group each
GRAPH_SNAPSHOT = "2020-07"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (A1)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _page_key(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("bigint")


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-view log in the shape of the page-view actor table (§1)."""
    return pageviews_from_events(table(spark, sf_dir, "events"))


def pageviews_from_events(ev: DataFrame) -> DataFrame:
    """The page-view shape of ``events`` rows (batch or streaming frame)."""
    k = _page_key()
    eid = F.col("event_id")
    et = F.col("event_type")
    return ev.select(
        F.col("user_id").cast("string").alias("actor"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.hour("ts").alias("hour"),
        (eid % 10 != 0).alias("is_pageview"),
        F.when(eid % 7 == 0, F.lit("spider")).otherwise(F.lit("user")).alias("agent_type"),
        F.when(et == "click", F.lit("desktop"))
        .when(et == "signup", F.lit("mobile app"))
        .when(et == "error", F.lit(None).cast("string"))
        .otherwise(F.lit("mobile web")).alias("access_method"),
        F.struct(
            F.when(eid % 13 == 0, F.lit("wiktionary")).otherwise(F.lit("wikipedia")).alias("project_family"),
            F.when(k % 4 == 0, F.lit("simple")).otherwise(F.lit("en")).alias("project"),
        ).alias("normalized_host"),
        F.when(k % 10 == 9, F.lit(1)).otherwise(F.lit(0)).alias("namespace_id"),
        k.alias("page_id"),
        F.when(eid % 50 == 1, F.lit(None)).otherwise(F.col("ts")).alias("ts"),
        F.create_map(F.lit("page_title"), F.concat(F.lit("page_"), k.cast("string"))).alias("pageview_info"),
    )


def raw_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views straight from ``events`` with no filtering: the input of
    the minimum slice (``actor, ts, page_id, page_title, wiki_db, qid``)."""
    pv = pageviews(spark, sf_dir)
    return pv.select(
        "actor",
        "ts",
        "page_id",
        F.col("pageview_info")["page_title"].alias("page_title"),
        F.concat(F.col("normalized_host.project"), F.lit("wiki")).alias("wiki_db"),
        F.lit(None).cast("string").alias("qid"),
    )


def item_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-to-page links with snapshots (§2): ``wiki_db, page_id, snapshot, item_id``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_custkey") % 4 == 0, F.lit("simplewiki")).otherwise(F.lit("enwiki")).alias("wiki_db"),
        F.col("o_custkey").alias("page_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot"),
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("item_id"),
    )


def _graph_wiki(key: Column) -> Column:
    return F.when(key % 50 == 49, F.lit("simplewiki")).otherwise(F.lit("enwiki"))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page table (§3): ``wiki_db, snapshot, page_id, page_title, page_namespace, page_is_redirect``."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        _graph_wiki(key).alias("wiki_db"),
        F.lit(GRAPH_SNAPSHOT).alias("snapshot"),
        key.alias("page_id"),
        F.concat(F.lit("page_"), key.cast("string")).alias("page_title"),
        F.when(key % 20 == 19, F.lit(1)).otherwise(F.lit(0)).alias("page_namespace"),
        (key % 7 == 3).alias("page_is_redirect"),
    )


def redirect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect table (§3): ``wiki_db, snapshot, rd_from, rd_title, rd_namespace``."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.where(key % 7 == 3).select(
        _graph_wiki(key).alias("wiki_db"),
        F.lit(GRAPH_SNAPSHOT).alias("snapshot"),
        key.alias("rd_from"),
        F.concat(F.lit("page_"), ((key * 13 + 5) % 3000).cast("string")).alias("rd_title"),
        F.when(key % 11 == 10, F.lit(1)).otherwise(F.lit(0)).alias("rd_namespace"),
    )


def pagelinks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-link table (§3): ``wiki_db, snapshot, pl_from, pl_title, pl_from_namespace, pl_namespace``."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey")
    return li.select(
        _graph_wiki(key).alias("wiki_db"),
        F.lit(GRAPH_SNAPSHOT).alias("snapshot"),
        key.alias("pl_from"),
        F.concat(F.lit("page_"), (F.col("l_orderkey") % 2500).cast("string")).alias("pl_title"),
        F.when(F.col("l_linenumber") == 7, F.lit(1)).otherwise(F.lit(0)).alias("pl_from_namespace"),
        F.when(F.col("l_suppkey") % 9 == 0, F.lit(1)).otherwise(F.lit(0)).alias("pl_namespace"),
    )


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages: ``page_id, url, html`` (spread over the cores, see ``spread``)."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), SCAN_TASKS)


def page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages in the shape of a page dump (``sources.tables.DUMP_SCHEMA``): every article's lead has nested,
    unclosed and inline marks around its id and address, and a later revision that must not be read."""
    key = F.col("page_id")
    name, address = key.cast("string"), F.coalesce("url", F.lit(""))
    unclosed = F.when(key % 5 == 0, " {{ open").when(key % 5 == 1, " [[ open").when(key % 5 == 2, " {| open").otherwise("")
    text = F.concat(F.lit("<!-- c -->{{Infobox|a={{nested|"), name, F.lit("}}|b=[[x]]}}\n[[File:p.png|thumb|see [[q|r]] ]]\'\'\'P"), name, F.lit("\'\'\' is [[target|label "), name,
                    F.lit("]]<ref>note</ref> &eacute;&copy;&#233; {{{1|given}}} [ftp://x.y/ site] {|\n| cell {| inner |}\n|}"), unclosed, F.lit("\nSee "), address,
                    F.lit(" there.\n== History ==\nLater {{text}}."))
    text_of = lambda c: F.struct(c.alias("_VALUE"), F.octet_length(c).cast("long").alias("_bytes"))
    revisions = F.array(*(F.struct((key * 10 + i).alias("id"), text_of(c).alias("text")) for i, c in enumerate((text, F.lit("another revision")))))
    return spread(table(spark, sf_dir, "pages").select(
        key.alias("id"), F.when(key % 10 == 9, 1).otherwise(0).alias("ns"), F.concat(F.lit("page_"), name).alias("title"),
        F.when(key % 7 == 3, F.struct(F.lit("page_0").alias("_title"))).alias("redirect"), revisions.alias("revision")), SCAN_TASKS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document corpus for text search: ``doc_id, text`` (doc_id is the page id)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), SCAN_TASKS)


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page vectors: ``page_id, vector`` (``vec_id`` is the page id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))


def word_vectors_for(spark: SparkSession, sf_dir: str, words: DataFrame,
                     word_col: str = "word") -> DataFrame:
    """Word-vector table ``word, vector`` for the distinct words of ``words``.

    The test data has no word model, so a word's vector is the row
    ``md5int(word) % n`` of the whole embeddings table of ``n`` rows.
    """
    emb = table(spark, sf_dir, "embeddings")
    vocab = (words.select(F.col(word_col).alias("word")).distinct()
             .withColumn("vec_id", md5int("word") % F.lit(emb.count())))
    return vocab.join(emb.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("word", "vector")


def known_word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Word vectors of ``words`` but for those with ``md5int(word) % 3 = 0``, which stay unknown."""
    return word_vectors_for(spark, sf_dir, words.where(md5int("word") % 3 != 0))


def bucket_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket table of character n-grams, ``bucket, vector``: the whole embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vector"))
