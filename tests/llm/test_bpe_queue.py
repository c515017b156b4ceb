import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import clashing, corpus, empty

from readpaths.llm import bpe_queue as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RAW = f.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RAW, public_tokenizers.PATTERN)


def ids_of(texts):
    flat, counts = ENCODER(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@pytest.mark.parametrize("text", ["", "a" * 4000, "ab" * 3000, "aaab" * 2222, "=" * 999 + "-=" * 500, "I'll don't  go\n\n  x", "é" * 500, "\x00\x00a \x00", "<|endoftext|>", " " * 300 + "x", "𝔘𝔫𝔦 " * 90])
def test_as_the_library(text):
    assert ids_of([text]) == [LIBRARY.encode_ordinary(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbt hein'1.\n"), st.characters(exclude_categories=("Cs",))), max_size=80), max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_merges_that_create_lower_ranks():
    """A vocabulary where merging 'ab' makes 'abc' of a lower rank, so 'abc' must come before the next 'ab'."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"cd": 257, b"abc": 258, b"abab": 259, b"ab": 260, b"aba": 261, b"xab": 262}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    library = tiktoken.Encoding("low", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    encoder = B.Encoder(raw, r"[^ ]+| ")
    rng = random.Random(0)
    texts = ["".join(rng.choices("abcdx ", weights=(5, 5, 1, 1, 1, 1), k=rng.randint(1, 60))) for _ in range(500)] + ["ababab", "xabababc", "aabab" * 50]
    flat, counts = encoder(texts)
    assert flat.tolist() == [i for t in texts for i in library.encode_ordinary(t)] and counts.sum() == len(flat)


def test_queue_pops_ranks_in_order():
    import numpy as np

    rng = random.Random(1)
    queue, held = B.RankQueue(300_000), {}
    for step in range(400):
        ranks = np.array([rng.randrange(300_000) for _ in range(rng.randint(0, 9))])
        positions = np.arange(len(ranks)) + 100 * step
        queue.push(ranks, positions)
        for r, p in zip(ranks.tolist(), positions.tolist(), strict=True):
            held.setdefault(r, []).append(p)
        for _ in range(rng.randint(0, 5)):
            got = queue.pop()
            if not held:
                assert got is None
                break
            low = min(held)
            assert (got[0], got[1].tolist()) == (low, sorted(held.pop(low)))
    while held:
        low = min(held)
        got = queue.pop()
        assert (got[0], got[1].tolist()) == (low, sorted(held.pop(low)))
    assert queue.pop() is None


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "KNOWN_WORDS", 5)
    monkeypatch.setattr(B, "KNOWN_CHARS", 6)
    texts = ["one two three four five six", "seven one eight", "two two ten eleven", "one"] * 3
    encoder = B.Encoder(RAW, public_tokenizers.PATTERN)
    for t in texts:
        assert encoder([t])[0].tolist() == LIBRARY.encode_ordinary(t)


def test_words_between_single_spaces_are_enough():
    rng, encoder = random.Random(8), B.Encoder(RAW, public_tokenizers.PATTERN)
    letters = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Bc", "é", "1", "23", "'", "'s", "'ll", "#", "!?", "中", "😀", "\x00"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    ids, counts = encoder(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_query_shape_and_round_trip(spark):
    docs = clashing(corpus(spark), "ids", "id", "n_tokens")
    encoded = B.encode(docs, PATH, public_tokenizers.PATTERN)
    out = B.decode(encoded, PATH, public_tokenizers.PATTERN).drop("ids")
    got = sorted(str(tuple(r)) for r in out.collect())
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want.append(str((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got == sorted(want)
    back = B.decode_text(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((r["doc_id"], r["text"] or "")) for r in docs.collect())


def test_empty_table(spark):
    assert B.decode(B.encode(empty(spark), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).count() == 0
