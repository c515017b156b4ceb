import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readpaths.operators import subwords as sw
from readpaths.plans import jobs


def plain_hash(text):
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ (b - 256 if b > 127 else b) & 0xFFFFFFFF) * 0x01000193) & 0xFFFFFFFF
    return h


def plain_ngrams(word, low, high):
    w = f"<{word}>"
    return [w[i:i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


WORDS = ["a", "foobar", "naïve", "日本語", "𝐀𝐁𝐂x", "aaaaaaaa", "été9"]


def test_hash_has_the_published_values(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(sw.fnv1a("t").alias("h")).collect()
    assert [r["h"] for r in rows] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_ngrams_and_hashes_equal_plain_ones(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string").select("word", sw.character_ngrams("word").alias("g"))
    df = df.select("word", "g", F.transform("g", sw.fnv1a).alias("h"))
    for r in df.collect():
        assert r["g"] == plain_ngrams(r["word"], sw.MIN_N, sw.MAX_N)
        assert r["h"] == [plain_hash(g) for g in r["g"]]


def test_bounds_of_ngrams_are_checked():
    with pytest.raises(ValueError):
        sw.character_ngrams("word", 1, 3)
    with pytest.raises(ValueError):
        sw.character_ngrams("word", 4, 3)


def buckets_of(spark, n, size=3):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(n, size))
    return table, spark.createDataFrame([(i, table[i].tolist()) for i in range(n)], "bucket long, vector array<double>")


def test_vectors_are_means_over_ngrams_repeats_nulls_and_missing_buckets(spark):
    n = 50
    table, buckets = buckets_of(spark, n)
    words = spark.createDataFrame([(w, 1) for w in [*WORDS, "foobar", "", None]], "word string, bucket int")
    got = {r["word"]: r["vector"] for r in sw.subword_vectors(words, buckets, n).collect()}
    assert sorted(got) == sorted(WORDS)
    for w in WORDS:
        want = np.mean([table[plain_hash(g) % n] for g in plain_ngrams(w, 3, 6)], axis=0)
        assert got[w] == pytest.approx(want.tolist())
    held = {i for i in range(n) if i % 2}
    got = {r["word"]: r["vector"] for r in sw.subword_vectors(words, buckets.where("bucket % 2 = 1"), n).collect()}
    for w in WORDS:
        rows = [table[b] for b in (plain_hash(g) % n for g in plain_ngrams(w, 3, 6)) if b in held]
        assert (w in got) == bool(rows) and (not rows or got[w] == pytest.approx(np.mean(rows, axis=0).tolist()))
    assert sw.subword_vectors(words.limit(0), buckets, n).count() == 0 == sw.subword_vectors(words, buckets.limit(0), n).count()


def test_a_very_long_word_takes_time_in_proportion(spark):
    n = 50
    table, buckets = buckets_of(spark, n)
    word = "ab" * 200_000
    began = time.time()
    got = sw.subword_vectors(spark.createDataFrame([(word,)], "word string"), buckets, n).first()["vector"]
    assert time.time() - began < 60
    assert got == pytest.approx(np.mean([table[plain_hash(g) % n] for g in plain_ngrams(word, 3, 6)], axis=0).tolist())


def unit(v):
    return np.asarray(v) / np.linalg.norm(v)


def test_unknown_words_take_part_in_text_vectors(spark):
    n = 50
    table, buckets = buckets_of(spark, n, 2)
    texts = spark.createDataFrame([(1, "cat cat zebra"), (2, "zebra"), (3, ""), (4, None)], "page_id long, text string")
    known = spark.createDataFrame([("cat", [3.0, 4.0]), ("other", [1.0, 0.0])], "word string, vector array<float>")
    zebra = unit(np.mean([table[plain_hash(g) % n] for g in plain_ngrams("zebra", 3, 6)], axis=0))
    rows = {r["page_id"]: r["vector"] for r in sw.text_vectors_subwords(texts, known, buckets, n, digits=None).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[3] == rows[4] == [0.0, 0.0]
    assert rows[1] == pytest.approx(((2 * np.array([0.6, 0.8]) + zebra) / 3).tolist())
    assert rows[2] == pytest.approx(zebra.tolist())
    nothing = {r["page_id"]: r["vector"] for r in sw.text_vectors_subwords(texts, known.limit(0), buckets.limit(0), n).collect()}
    assert nothing == {1: [], 2: [], 3: [], 4: []}


@pytest.mark.parametrize("dimensions", [None, 2])
def test_dump_job_with_buckets(spark, dimensions):
    n = 40
    _, buckets = buckets_of(spark, n)
    rows = [(1, 0, "A", None, [(1, ("cat zebra\n== H ==\nx", 5))]), (2, 0, "B", None, [(2, ("", 0))])]
    dump = spark.createDataFrame(rows, "id long, ns int, title string, redirect struct<_title:string>, "
                                       "revision array<struct<id:long,text:struct<_VALUE:string,_bytes:long>>>")
    known = spark.createDataFrame([("cat", [1.0, 2.0, 2.0])], "word string, vector array<double>")
    got = {r["page_id"]: r["vector"] for r in jobs.dump_vectors_job(dump, known, dimensions=dimensions, buckets=buckets, n_buckets=n).collect()}
    size = dimensions or 3
    assert sorted(got) == [1, 2] and len(got[1]) == size and got[2] == [0.0] * size and any(got[1])
