import hashlib

import numpy as np
import pytest
from llm_frames import clashing, corpus, empty, prose, texts

from readpaths.llm import blocks as bl
from readpaths.llm import substring_dedup as D

SPACES = " \t\n\v\f\r"


def split(text):
    return [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]


def plain(rows, n=50):
    low = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            low[key] = min(low.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if low[tuple(w[k : k + n])] < (float("inf") if i is None else i):
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = corpus(spark, seed)
    got = rows_of(D.repeats(clashing(docs, "block", "n_words", "spans", "keys")))
    assert got == plain(texts(docs))
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize(("n", "q"), [(5, 1), (5, 5), (8, 3), (50, 50)])
def test_other_lengths(spark, n, q):
    docs = corpus(spark, 3, n=25)
    assert rows_of(D.repeats(docs, min_words=n, anchor_words=q)) == plain(texts(docs), n)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(bl, "BUCKET_BYTES", 200)
    docs = corpus(spark, 4)
    table = bl.block_table(docs, block_bytes=3000)
    assert table.count() > 10 and bl.bucket_bits(table) > 8
    monkeypatch.setattr(bl.block_table, "__defaults__", ("text", 3000, 7))
    assert rows_of(D.repeats(docs)) == plain(texts(docs))


def test_text_keeps_its_white_space(spark):
    import random

    rng = random.Random(5)
    p = prose(rng, 60)
    docs = spark.createDataFrame([(1, f"start\n{p}\nend"), (2, f"  other\tlead\n{p}  tail of\nit \n"), (3, "un\n touched ")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in D.repeats(docs).collect()}
    assert got == {1: (f"start\n{p}\nend", []), 2: ("  other\tlead\ntail of\nit", [(2, 62)]), 3: ("un\n touched ", [])}


def test_other_columns_stay(spark):
    docs = corpus(spark).drop("n_chars")
    out = D.repeats(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_words", "n_removed", "spans", "kept_sha256", "text"]
    assert sorted((str((r["doc_id"], r["lang"], r["source"])) for r in out.collect())) == sorted(str((r["doc_id"], r["lang"], r["source"])) for r in docs.collect())


def test_empty_table(spark):
    assert D.repeats(empty(spark)).count() == 0
    assert rows_of(D.repeats(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))) == plain([(1, None), (None, "")])


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for top in (1, 255, 256, 1 << 40, (1 << 64) - 1):
        v = rng.integers(0, top, 999, dtype=np.uint64, endpoint=True)
        assert (bl.unpack(bl.pack(v), len(v)) == v).all()
        k = np.unique(v)
        assert (bl.unpack_keys(bl.pack_keys(k), len(k)) == k).all()
    assert len(bl.unpack(bl.pack(np.zeros(0, np.uint64)), 0)) == 0
