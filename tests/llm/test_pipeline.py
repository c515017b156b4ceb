import hashlib

import public_tokenizers
import pytest
from llm_frames import corpus, empty
from test_simhash_ring import plain_smallest
from test_substring_dedup import plain as plain_repeats

import corpus_pipeline as C
from readpaths.llm import bpe_queue, quality_kn, raking


def test_stages_and_queries():
    import __spark_entry__ as entry

    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing_sources", "byte_bpe"]
    names = entry.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, read back from Parquet as the pipeline does."""
    base = tmp_path_factory.mktemp("pipeline")
    corpus(spark, 6, n=200).write.parquet(f"{base}/documents.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = {}
    for name, stage in C.STAGES:
        stage(spark, docs, str(base)).write.parquet(f"{base}/{name}")
        after = spark.read.parquet(f"{base}/{name}")
        out[name] = (docs, after)
        docs = after
    out["run"] = str(base)
    return out


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_columns_stay(steps):
    for name, _ in C.STAGES[:-1]:
        assert steps[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(steps):
    before, after = steps["quality_rules"]
    assert ids(after) == ids(quality_kn.judge(before).where("kept")) and 0 < after.count() < before.count()


def test_near_dedup_stage(steps):
    before, after = steps["simhash_near_dedup"]
    want = plain_smallest([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted({c for _, _, c in want}, key=str)


def test_substring_stage(steps):
    before, after = steps["substring_dedup"]
    want = plain_repeats([(r["doc_id"], r["text"]) for r in before.collect()])
    got = sorted(((r["doc_id"], hashlib.sha256(" ".join((r["text"] or "").split()).encode()).hexdigest()) for r in after.collect()), key=str)
    assert got == [(w[0], w[3]) for w in want] and any(w[2] for w in want)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_stage(steps):
    before, after = steps["mixing_sources"]
    assert 0 < after.count() <= before.count() and set(map(str, ids(after))) <= set(map(str, ids(before)))
    tokens = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert tokens(after) < tokens(before) and raking.SEED


def test_token_stage(steps):
    before, after = steps["byte_bpe"]
    texts = {str(r["doc_id"]): r["text"] for r in before.collect()}
    encoder = bpe_queue.Encoder(open(public_tokenizers.path(C.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)
    for r in after.collect():
        text = texts[str(r["doc_id"])]
        assert r["ids"] == encoder([text])[0].tolist() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_all_stages(spark, steps):
    assert sorted(str(tuple(r)) for r in C.run(spark, steps["run"]).collect()) == sorted(str(tuple(r)) for r in steps["byte_bpe"][1].collect())


def test_empty_documents(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
