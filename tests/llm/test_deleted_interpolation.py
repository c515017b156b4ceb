import math
import zlib
from collections import Counter

import pytest
from llm_frames import clashing, corpus, empty, texts

from readpaths.llm import blocks as bl
from readpaths.llm import deleted_interpolation as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w] + [None]


def plain(rows):
    """Scores by dictionaries: one tuple per row."""
    docs = [(i, tokens(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7) for i, t in rows]

    def count(folds):
        one, two, context = Counter(), Counter(), Counter()
        for _, w, f in docs:
            if f in folds:
                before = ["<s>", *w[:-1]]
                one.update(w)
                context.update(before)
                two.update(zip(before, w, strict=True))
        return one, two, context

    one, two, context = count({0, 1, 3, 4, 5, 6})
    core1, core2, core_context = count({0, 1, 4, 5, 6})
    n, v, cn, cv = sum(one.values()), len(one), sum(core1.values()), len(core1)
    bucket = lambda c: min(math.frexp(c)[1], D.BUCKETS - 1)
    held = Counter()
    for _, w, f in docs:
        if f == 3:
            held.update((core_context[a], core1[b], core2[a, b]) for a, b in zip(["<s>", *w[:-1]], w, strict=True))
    weights = {b: [1 / 3] * 3 if b else [0, 1 / 2, 1 / 2] for b in range(D.BUCKETS)}
    for _ in range(D.ROUNDS):
        expected = {b: [D.PRIOR if b else 0, D.PRIOR, D.PRIOR] for b in weights}
        for (a, b, ab), times in held.items():
            parts = [x * y for x, y in zip(weights[bucket(a)], (ab / a if a else 0, b / max(cn, 1), 1 / (cv + 1)), strict=True)]
            for k in range(3):
                expected[bucket(a)][k] += times * parts[k] / sum(parts)
        weights = {b: [x / sum(e) for x in e] for b, e in expected.items()}
    out = []
    for i, w, f in docs:
        score = 0.0
        for a, b in zip(["<s>", *w[:-1]], w, strict=True):
            x, y, z = weights[bucket(context[a])] if n else (0, 0, 1)
            score += math.log10(x * (two[a, b] / context[a] if context[a] else 0) + y * one[b] / max(n, 1) + z / (v + 1))
        out.append((i, f == 2, len(w), sum(one[t] > 0 for t in w), n, sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w), score))
    return out


def check(got, want):
    key = lambda r: str((r[0], r[2], round(r[5], 6)))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_matches_plain_model(spark):
    docs = corpus(spark)
    out = D.score(clashing(docs, "fold", "block", "score"))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check(out.collect(), plain(texts(docs)))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl.block_table, "__defaults__", ("text", 2000, 5))
    monkeypatch.setattr(bl, "BUCKET_BYTES", 200)
    docs = corpus(spark, 2)
    check(D.score(docs).collect(), plain(texts(docs)))


def test_seen_words_score_above_unseen_ones(spark):
    rows = [(i, "a b a c b a") for i in range(1, 40)]
    docs = spark.createDataFrame([*rows, (1000, "a"), (1003, ""), (1004, "zzz")], "doc_id long, text string")
    got = D.score(docs).collect()
    check(got, plain(texts(docs)))
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1004] < score[1000]


def test_probabilities_sum_to_one(spark):
    """Of all tokens that can follow a seen or an unseen context: the known ones, the end and one unknown."""
    words = ["a", "b", "c", "d"]
    train = [(i, " ".join(words[(i + j * j) % 3] for j in range(i % 5)) or "d") for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    known = sorted({w for _, t in train for w in t.split()})
    for context in ("a", "never"):
        asked = [(held[k], f"{context} {w}" if w else context) for k, w in enumerate([*known, "zzz", None])]
        score = {r["doc_id"]: r["score"] for r in D.score(spark.createDataFrame([*train, *asked], "doc_id long, text string")).collect()}
        # P(context w END) / P(END | w) is not read off directly, so the model itself is asked for its parts
        rows = [*train, *asked]
        want = {r[0]: r[-1] for r in plain(rows)}
        assert all(score[i] == pytest.approx(want[i], rel=1e-9) for i, _ in asked)
    only = D.score(spark.createDataFrame([(held[0], "")], "doc_id long, text string")).collect()
    assert only[0]["score"] == 0.0


def test_weights_of_unseen_contexts_are_a_distribution(spark):
    rows = spark.createDataFrame([(0, 0, 3, 0, 5), (0, 0, 0, 0, 2), (1, 1, 3, 1, 4)], "bucket int, c_context long, c_word long, c_pair long, n long")
    weights = D.fit_weights(rows, D.Corpus(10, 4))
    assert weights.sum(axis=1) == pytest.approx(1.0) and weights[0, 0] == 0 and weights[1, 0] > 0
    # unseen context: the known types share the unigram part, each of types + 1 the uniform one
    assert sum(weights[0, 1] * c / 10 + weights[0, 2] / 5 for c in (4, 3, 2, 1, 0)) == pytest.approx(1.0)


def test_no_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    docs = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    check(D.score(docs).collect(), plain(texts(docs)))


def test_empty_table(spark):
    assert D.score(empty(spark)).count() == 0
