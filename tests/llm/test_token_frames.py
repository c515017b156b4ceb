import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_frames import clashing, corpus, empty, prose
from tokenizers import Tokenizer

from readpaths.llm import token_frames as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, T.END_ID]


def answers(df):
    return sorted(((r["start"], str(r["doc_id"]), r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in df.collect()))


@pytest.mark.parametrize("file_bytes", [T.FILE_BYTES, 3000])
def test_documents_come_back_in_order(spark, tmp_path, plain, file_bytes):
    docs = corpus(spark)
    path = f"{tmp_path}/set"
    T.write(clashing(docs, "frame", "mark", "copy", "file", "start"), path, VOCABULARY, file_bytes=file_bytes)
    got = answers(T.read(spark, path))
    rows = docs.collect()
    assert sorted((i, ids) for _, i, _, ids in got) == sorted((str(r["doc_id"]), plain(r["text"])) for r in rows)
    start, order = 0, []
    for begins, doc_id, n, ids in got:
        assert begins == start and n == len(ids)
        start += n
        order.append(float("-inf") if doc_id == "None" else int(doc_id))
    assert order == sorted(order)
    files = list((tmp_path / "set" / "data").iterdir())
    assert len(files) <= 2 if file_bytes > 3000 else len(files) > 4
    for f in files:  # a file's own offset index agrees with the table
        index = T.index(spark, path).where(f"file = '{f.name}'").orderBy("offset").collect()
        assert T.offsets_of(f.read_bytes()).tolist() == [r["offset"] for r in index] + [index[-1]["offset"] + index[-1]["length"]]


def test_words_between_white_space_are_enough(plain):
    encode = T.Encoder(open(VOCABULARY).read())
    rng = random.Random(3)
    letters = ["a", "B", "é", "é", "İ", "ς", "Σ", "ß", "中", "文", "😀", "'s", "'LL", "1", "22", "_", "—", " ", " ", "　", "\u0085", "\x1c", "\x00", "́", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice([*letters, " ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = [np.frombuffer(x, encode.kind).tolist() for x in encode(t.encode() for t in texts)]
    assert got == [plain(t) for t in texts]


def test_plain_words_need_the_merge_model_only(plain):
    encode, rng = T.Encoder(open(VOCABULARY).read()), random.Random(6)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    words = ["".join(rng.choices(letters if i % 2 else letters[:52], k=rng.randint(1, 12))) + "".join(rng.choices(marks, k=rng.randint(0, 3))) for i in range(20_000)]
    words += [chr(c) + m for c in range(0x21, 0x250) for m in ("", ".", "'s", "\u0301", "\u0331")]
    assert sum(bool(T.PLAIN_WORD.fullmatch(w)) for w in words) > 8000
    got = [np.frombuffer(x, encode.kind).tolist() for x in encode(w.encode() for w in words)]
    assert got == [plain(w) for w in words]


def test_words_forgotten_are_encoded_again(monkeypatch, plain):
    monkeypatch.setattr(T, "KNOWN_WORDS", 20)
    monkeypatch.setattr(T, "KNOWN_BYTES", 3)
    encode, rng = T.Encoder(open(VOCABULARY).read()), random.Random(4)
    texts = [prose(rng, 50, 300) for _ in range(40)]
    assert [np.frombuffer(x, encode.kind).tolist() for x in encode(t.encode() for t in texts)] == [plain(t) for t in texts]
    assert len(encode.new) <= 70 and len(encode.old) <= 70


def test_lookup_reads_some_documents(spark, tmp_path, plain):
    docs = corpus(spark, n=30)
    path = f"file://{tmp_path}/set"
    T.write(docs, path, VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (4, 8, 31)").collect()}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in T.lookup(spark, path, [4, 8, 31, 999]).collect()} == {i: plain(t) for i, t in texts.items()}


def test_dictionary_helps_short_documents_and_must_match(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 60, 200)) for i in range(800)], "doc_id long, text string")
    path = f"{tmp_path}/set"
    T.write(docs, path, VOCABULARY)
    vocabulary = open(VOCABULARY).read()
    alone = sum(len(r["frame"]) for r in T.frames(docs, vocabulary, b"").collect())
    assert sum(r["length"] for r in T.index(spark, path).collect()) < 0.8 * alone
    (tmp_path / "set" / "dictionary").write_bytes(b"x" * 500)
    with pytest.raises(Exception, match="was not written with the dictionary|PythonException"):
        T.read(spark, path).collect()


def test_small_and_empty_tables(spark, tmp_path, plain):
    T.write(empty(spark), f"{tmp_path}/none", VOCABULARY)
    assert T.read(spark, f"{tmp_path}/none").count() == 0
    T.write(spark.createDataFrame([(5, None), (5, None), (1, "")], "doc_id long, text string"), f"{tmp_path}/few", VOCABULARY)
    assert [x[1:] for x in answers(T.read(spark, f"{tmp_path}/few"))] == [("1", 1, [1]), ("5", 1, [1]), ("5", 1, [1])]


def test_a_file_of_a_lost_attempt_is_not_read(spark, tmp_path):
    docs, path = corpus(spark, n=20), f"{tmp_path}/set"
    T.write(docs, path, VOCABULARY)
    before = answers(T.read(spark, path))
    (tmp_path / "set" / "data" / "000000-0000-lost.bin").write_bytes(b"half a file")
    assert answers(T.read(spark, path)) == before


def test_the_query_checksums_the_ids(spark, plain):
    from readpaths.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.op11_token_frames(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(plain(r["text"]), "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
