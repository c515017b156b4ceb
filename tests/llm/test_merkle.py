import hashlib
import zlib

import pytest
from llm_frames import clashing, corpus, empty
from pyspark.sql import functions as F

from readpaths.llm import merkle as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain_tree(digests, fanout):
    """Root, and per leaf the levels' (slot, other digests)."""
    proofs = [[] for _ in digests]
    members = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        ups, groups = [], []
        for i in range(0, len(digests), fanout):
            run = digests[i : i + fanout]
            for slot in range(len(run)):
                for leaf in members[i + slot]:
                    proofs[leaf].append((slot, run[:slot] + run[slot + 1 :]))
            ups.append(sha("".join(run)))
            groups.append(sum(members[i : i + fanout], []))
        digests, members = ups, groups
    return (digests[0] if digests else None), proofs


def plain(rows, fanout):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)) for r in rows if r["lang"] == lang)
        trees[lang] = own, *plain_tree([x[2] for x in own], fanout)
    root, upper = plain_tree([trees[lang][1] for lang in langs], fanout)
    return sorted((str(x[1] if x[0] else None), str(lang), x[2], trees[lang][1], root, [(s, "".join(o)) for s, o in proof + upper[i]])
                  for i, lang in enumerate(langs) for x, proof in zip(trees[lang][0], trees[lang][2], strict=True))


def answers(df):
    return sorted((str(r["doc_id"]), str(r["lang"]), r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), [(p["slot"], p["siblings"].hex()) for p in r["proof"]]) for r in df.collect())


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_against_plain_trees(spark, fanout):
    docs = corpus(spark)
    made = M.manifest(clashing(docs, "grp", "idx", "n", "digest", "slot", "proof", "root"), FIELDS, "doc_id", "lang", fanout=fanout)
    assert answers(made) == plain(docs.collect(), fanout)


def test_folding_finds_changed_rows(spark):
    docs = corpus(spark, n=40)
    other = M.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = M.manifest(docs, FIELDS, "doc_id", "lang", carry={"changed": F.unhex(other), "n": F.col("n_chars")})
    text = lambda c: F.lower(F.hex(c))
    out = made.select("n", (M.fold(text("leaf"), F.col("proof")) == text("root")).alias("same"), (M.fold(text("changed"), F.col("proof")) == text("root")).alias("other"),
                      "proof", M.proof_digest(F.col("proof")).alias("digest")).collect()
    assert all(r["same"] for r in out) and [r["other"] for r in out] == [r["n"] is None for r in out]
    assert all(r["digest"] == sha("".join(p["siblings"].hex() for p in r["proof"])) for r in out)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_one_group_of_any_size(spark, n):
    rows = [{"doc_id": i // 2, "source": None, "lang": "x", "n_chars": 1, "text": str(i)} for i in range(n)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert answers(M.manifest(docs, FIELDS, "doc_id", "lang")) == plain(rows, 2)


def test_one_key_for_most_rows(spark):
    """Rows of one key are spread over partitions; equal rows are leaves of their own."""
    rows = [{"doc_id": 7 if i % 3 else i, "source": "s", "lang": ("a", "", None)[i % 5 % 3], "n_chars": 1, "text": "t" * (i % 4)} for i in range(300)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert answers(M.manifest(docs, FIELDS, "doc_id", "lang")) == plain(rows, 2)


def test_empty_table(spark):
    made = M.manifest(empty(spark), FIELDS, "doc_id", "lang")
    assert made.count() == 0 and made.columns == ["doc_id", "lang", "idx", "leaf", "subroot", "root", "proof"]


def test_the_checksum_of_the_query(spark):
    got = spark.range(2000).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in got)


def test_levels_join_by_index_not_by_group(spark):
    """A level's join is on group and index, so no group is one task, and no window sees leaves."""
    nodes = spark.range(64).select(F.lit("g").alias("grp"), F.col("id").alias("idx"), F.lit(64).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = M.with_siblings(nodes, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "at_" in plan
