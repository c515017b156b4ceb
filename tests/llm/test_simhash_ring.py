import random

import numpy as np
import pytest
import xxhash
from llm_frames import clashing, corpus, empty, texts
from pyspark.sql import functions as F

from readpaths.llm import simhash_ring as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, max_bits):
    """Smallest reachable position of each mark."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def plain_smallest(rows, max_bits=2):
    marks = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(marks, max_bits)
    ids = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return sorted(((i, f"{m:016x}", ids.get(r)) for (i, _), m, r in zip(rows, marks, roots, strict=True)), key=str)


def test_near_duplicates_match_brute_force(spark):
    docs = corpus(spark)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(clashing(docs, "fingerprint", "root", "first")).collect()), key=str)
    assert got == plain_smallest(texts(docs))


def test_spark_hash_is_the_same(spark):
    r = spark.sql("select hash64 from (select xxhash64('a b c') as hash64)").first()
    assert r[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_find_every_pair(spark, max_bits):
    rng = random.Random(max_bits)
    marks = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for m in list(marks)[:12]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, max_bits + 1)):
                m ^= 1 << b
            marks.add(m)
    signed = np.array(sorted(marks), dtype=np.uint64).view(np.int64).tolist()
    got = {(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), max_bits).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits}
    assert len(got) > 50


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 4), (4, 5), (300, 7), (3, 3)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(200, 260)}, 7: 7, 300: 7, 4: 4, 5: 4}


def test_keep_one_row_of_each_component(spark):
    docs = clashing(corpus(spark), "fingerprint", "number", "row", "first")
    want = plain_smallest(texts(docs))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in want}, key=str)


def test_empty_table(spark):
    out = S.near_duplicates(empty(spark))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
    assert S.keep_one(empty(spark)).count() == 0


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert S.near_duplicates(docs).where(F.col("component_id").isNull()).count() == 3
    assert S.keep_one(docs).count() == 2
