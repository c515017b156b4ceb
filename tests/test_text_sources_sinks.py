"""Text operators, page-dump source, sinks and model operators."""

import bz2
import gzip
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readpaths.operators import models
from readpaths.operators import text as tx
from readpaths.sinks import writers as wr
from readpaths.sources import tables as tb


def test_lead_from_html(spark):
    html = ("<html><head><title>x</title></head><body><nav>menu</nav><article><h1>Title</h1>"
            "<p>First  <b>bold</b>\n para.</p><h2>Next</h2><p>rest</p></article></body></html>")
    df = spark.createDataFrame([(1, html), (2, "<p>no article</p>")], "page_id long, html string")
    got = dict((r["page_id"], r["text"]) for r in tx.lead_text(df).collect())
    assert got == {1: "Title First bold para.", 2: ""}


def test_lead_from_wikitext(spark):
    text = ("'''Foo''' is a [[bar|Bar]] thing{{cite|x}}.<ref>note</ref>\nMore [[baz]] text.\n"
            "== History ==\nLater text.")
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.lead_from_wikitext("t").alias("x")).collect()[0]["x"] == "Foo is a Bar thing. More baz text."


@pytest.mark.parametrize(("text", "want"), [
    ("== A ==\nfoo", ""), ("x = y\n= no heading\nmore\n=== H ===  \nz", "x = y = no heading more"), ("{{a|{{b|{{c}}}}}}x", "x"), ("{{never closed", "{{never closed"),
    ("[[File:x.jpg|thumb|see [[Foo]] here]] tail", "tail"), ("[[a]] [[File:q]] [[b|B [[c]] d]] [http://x.y lab el] [[Category:Z]]e", "a B c d lab el e"),
    ("a&nbsp;b &amp;lt; &#233;&#x1F600; &ndash; c", "a b &lt; é😀 – c"), ("{| class\n| {{x}} {| n |} |}after", "after"), ("a<br>b<ref name=x/>c <!-- d -->e", "a bc e"), ("", ""), (None, None),
    ("a {{ b c", "a {{ b c"), ("start [[Foo|bar]] {| never closed … rest", "start bar {| never closed … rest"), ("x {{{1|y}}} z {{{2}}}.", "x y z ."), ("&eacute;&copy; &nope; &amp;copy; &#9;&#xD800;.", "é© &nope; &copy; &#xD800;."),
    ("[ftp://y z] [mailto:a@b c] [//u v] [no link]", "z c v [no link]"), ("{{a {{b}} c", "{{a c"), ("a}} [[b]] c]] |}", "a}} b c]] |}"), ("[[File:a|b [[c]] d", "[[File:a|b c d"),
    ("{{a|{b} [[c|d]] {| e |} }}f {x} [y] |z", "f {x} [y] |z"), ("{{" * 30 + "a" + "}}" * 30 + "b", "b"), ("{|\n|a|b\n|-\n|{{c}}\n|}d", "d")])
def test_wikitext_cases(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.lead_from_wikitext("t").alias("x")).first()["x"] == want


@pytest.mark.parametrize("text", ["{{" * 200_000, "[[" * 200_000, "{|" * 200_000, "{{a}} " * 100_000, "}}" * 200_000, "{{" + "x{y} " * 100_000 + "}}", "[[a|" * 100_000, "{{{1|" * 80_000])
def test_wikitext_of_many_marks_takes_little_time(spark, text):
    began = time.time()
    out = spark.createDataFrame([(text,)], "t string").select(tx.lead_from_wikitext("t").alias("x")).first()["x"]
    assert (out == "") == (text[:4] in ("{{a}", "{{x{")) and time.time() - began < 30


DUMP = """<mediawiki>
<page><title>Alpha</title><ns>0</ns><id>1</id>
  <revision><id>11</id><text xml:space="preserve">Alpha is [[beta]].
== Section ==
tail</text></revision></page>
<page><title>Beta redirect</title><ns>0</ns><id>2</id><redirect title="Alpha" />
  <revision><id>12</id><text>#REDIRECT [[Alpha]]</text></revision></page>
<page><title>Talk:Alpha</title><ns>1</ns><id>3</id>
  <revision><id>13</id><text>talk</text></revision></page>
</mediawiki>
"""


def test_page_dump_source_skips_redirects_and_namespaces(spark, tmp_dir):
    path = os.path.join(tmp_dir, "xwiki-20200801-pages-articles1.xml.bz2")
    with open(path, "wb") as f:
        f.write(bz2.compress(DUMP.encode()))
    with open(os.path.join(tmp_dir, "xwiki-20200801-pages-articles-multistream1.xml.bz2"), "wb") as f:
        f.write(b"")
    paths = tb.dump_paths(spark, tmp_dir, "xwiki", "20200801")
    assert paths == [f"file:{path}"]
    arts = tx.dump_articles(tb.read_page_dump(spark, paths)).collect()
    assert [(r["page_id"], r["page_title"], r["text"]) for r in arts] == [(1, "Alpha", "Alpha is beta.")]


def test_dump_paths_fall_back_to_full_file(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "ywiki-20200801-pages-articles.xml.bz2"), "wb") as f:
        f.write(bz2.compress(DUMP.encode()))
    paths = tb.dump_paths(spark, tmp_dir, "ywiki", "20200801")
    assert paths == [f"{tmp_dir}/ywiki-20200801-pages-articles.xml.bz2"] and tb.read_page_dump(spark, paths).count() == 3
    assert tb.dump_paths(spark, tmp_dir, "none", "20200801") == [f"{tmp_dir}/none-20200801-pages-articles.xml.bz2"]


def test_text_vectors_mean_of_unit_word_vectors(spark):
    texts = spark.createDataFrame([(1, "cat cat dog xx"), (2, "zzz"), (3, ""), (4, None), (5, "7up zero")], "page_id long, text string")
    wv = spark.createDataFrame([("cat", [3.0, 4.0]), ("dog", [0.0, 2.0]), ("zero", [0.0, 0.0]), ("7up", [0.0, 5.0])],
                               "word string, vector array<float>")
    got = {r["page_id"]: r["vector"] for r in tx.text_vectors(texts, wv).collect()}
    exp = (2 * np.array([0.6, 0.8]) + np.array([0.0, 1.0])) / 3
    assert sorted(got) == [1, 2, 3, 4, 5] and got[2] == got[3] == got[4] == [0.0, 0.0] and got[5] == [0.0, 1.0]
    assert got[1] == pytest.approx(exp.round(6).tolist())


def test_vector_lines_format(spark, tmp_dir):
    v = spark.createDataFrame([(7, [0.5, -0.123456789])], "page_id long, vector array<double>")
    out = os.path.join(tmp_dir, "vec")
    wr.write_vector_lines(v, out)
    files = [f for f in os.listdir(out) if f.endswith(".gz")]
    lines = [ln for f in files for ln in gzip.open(os.path.join(out, f), "rt").read().splitlines()]
    assert lines == ["7 0.50000 -0.12346"]


def test_session_lines_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("1 2 3",), ("4 5",)], "line string")
    out = os.path.join(tmp_dir, "sessions")
    wr.write_lines(df, out)
    back = tb.read_session_lines(spark, out).collect()
    assert sorted(r["page_ids"] for r in back) == [["1", "2", "3"], ["4", "5"]]


def test_counted_observation(spark, tmp_dir):
    df = spark.range(17)
    out, obs = wr.counted(df)
    wr.write_parquet(out, os.path.join(tmp_dir, "p"))
    assert obs.get["n_rows"] == 17


def test_output_names():
    assert wr.output_name("sessions", "enwiki", "2020-04-01-00", "2020-04-09-00") == \
        "reading-sessions-actors_enwiki_2020-04-01-00_2020-04-09-00"
    assert wr.output_name("nodes", "simplewiki", "2020-07") == "graph_simplewiki_2020-07_nodes.parquet"
    assert wr.output_name("vectors", "enwiki", "20200801", "50") == "embedding-text_fasttext_enwiki_20200801_50.vec.gz"


def test_pca_dimensions(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)], "page_id long, vector array<double>")
    out = models.reduce_dimension(df, k=3).collect()
    x = np.array([r["vector"] for r in sorted(df.collect(), key=lambda r: r["page_id"])])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ axes[:, np.argsort(-values)[:3]])
    assert np.abs([r["vector"] for r in sorted(out, key=lambda r: r["page_id"])]) == pytest.approx(want, abs=1e-8)


def test_run_reading_sessions_writes_gzip(spark, tmp_dir):
    from readpaths.plans import jobs
    from readpaths.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    path = jobs.run_reading_sessions(spark, fx.pageviews(spark, d), fx.item_links(spark, d), tmp_dir,
                                     "2024-01-01", "2024-02-01", "en", item_since="2000-01-01")
    assert os.path.basename(path) == "reading-sessions-actors_enwiki_2024-01-01_2024-02-01"
    lines = spark.read.text(path)
    assert lines.count() > 0
    assert lines.where(F.col("value").rlike("^[0-9]+( [0-9]+)+$")).count() == lines.count()


def test_run_reading_sessions_of_all_wikis(spark, tmp_dir):
    from readpaths.plans import jobs
    from readpaths.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    path = jobs.run_reading_sessions(spark, fx.pageviews(spark, d), fx.item_links(spark, d), tmp_dir, "2024-01-01", "2024-02-01", None, item_since="2000-01-01")
    assert os.path.basename(path) == "reading-sessions-actors_allwikis_2024-01-01_2024-02-01" and spark.read.text(path).count() > 0


def test_dump_vectors_job(spark, tmp_dir):
    from readpaths.plans import jobs

    path = os.path.join(tmp_dir, "zwiki-20200801-pages-articles.xml.bz2")
    with open(path, "wb") as f:
        f.write(bz2.compress(DUMP.encode()))
    wv = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 2.0])], "word string, vector array<float>")
    dump = tb.read_page_dump(spark, tb.dump_paths(spark, tmp_dir, "zwiki", "20200801"))
    out = jobs.dump_vectors_job(dump, wv).collect()
    assert [(r["page_id"], [round(x, 6) for x in r["vector"]]) for r in out] == [(1, [0.5, 0.5])]
    reduced = jobs.dump_vectors_job(dump, wv, dimensions=1).collect()
    assert [(r["page_id"], len(r["vector"])) for r in reduced] == [(1, 1)]


def test_text_search_evaluation_equals_catalog_metrics(spark):
    from readpaths.plans import catalog as C
    from readpaths.plans import jobs
    from readpaths.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    got = jobs.text_search_evaluation(C._sessions(spark, d), fx.documents(spark, d), C._graph_pages(spark, d), k=C.P.k, seed=C.P.seed)
    exp = C.q_metrics_by_split(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_session_lines_refuses_unbounded_collect(spark):
    from readpaths.operators import sessions as ss

    df = spark.createDataFrame([], "actor string, session_no int, ts timestamp, page_id long, page_title string, "
                                   "wiki_db string, qid string")
    with pytest.raises(ValueError):
        ss.session_lines(df, max_length=None)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_word_vectors_travel_once_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(tx, "BLOCK_WORDS", block)
    monkeypatch.setattr(tx, "CELLS", 4)
    texts = spark.createDataFrame([(1, "a b b"), (2, "c a zz"), (3, "zz"), (4, None), (None, "a"), (2, "b"), (5, "n")], "page_id long, text string")
    wv = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.0]), ("n", [0.0, 0.0])], "word string, vector array<double>")
    out = tx.text_vectors(texts, wv)
    # a word with two vectors counts with both; the two texts of page 2 are one
    two = [round((0.6 + 0 + 1 + 1) / 4, 6), round((0.8 + 1 + 0 + 0) / 4, 6)]
    got = sorted(((r["page_id"], r["vector"]) for r in out.collect()), key=str)
    assert got == sorted([(1, [0.52, 0.56]), (2, two), (2, two), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (None, [0.0, 0.0])], key=str)
    # no aggregation buffer of a vector's size for every count
    assert "summar" not in out._jdf.queryExecution().toString().lower()
