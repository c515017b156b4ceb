import base64
import gzip
import hashlib
import os

from llm_frames import clashing, empty
from pyspark.sql import functions as F

from readpaths.llm import warc as X

PAGES = "page_id long, url string, html string"
CUT = X.BOUNDARY + X.VERSION
ROWS = [(1, "http://a/b?c#d", "x" + CUT + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + CUT), (2, None, None), (3, "u\r\nv", ""), (4, "http://q", "\r\n\r\n"), (5, "http://a/b", CUT * 3), (5, "http://a/b", CUT * 3),
        (None, "z", CUT * 3), (7, "é", "é\U0001f600"), (8, "é", "é\U0001f600"), (9, "x", "WARC/1.1\r\n"), (None, "n", "solo"), (10, "y", X.VERSION + CUT + X.VERSION), (11, "big", "<p>" + "long text " * 30_000), (12, "big", "<p>" + "long text " * 30_000)]


def plain(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max((x for x in (top.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        data, best = (h or "").encode(), top[h or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == best else "revisit", None if i == best else best))
    return sorted(out, key=str)


def captured(df):
    return sorted((tuple(r)[:5] for r in X.captures(df).collect()), key=str)


def test_captures_match_brute_force(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    out = X.captures(clashing(pages, "digest", "response", "value", "type"))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == plain(ROWS)
    assert all(r["digest_ok"] for r in out.collect())


def test_payload_end_and_boundary_make_a_cut(spark):
    end = CUT[:-2]
    rows = [(1, "a", "x" + end), (2, "b", "WARC/1.1"), (3, "c", CUT + "y" + CUT + end), (4, "d", end + end), (5, "e", "x" + end), (6, "f", end + "\r\n"), (7, "g", "plain")]
    out = X.captures(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == plain(rows) and all(r["digest_ok"] for r in out)


def test_large_group_of_equal_payloads(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(600)]
    assert captured(spark.createDataFrame(rows, PAGES).repartition(7)) == plain(rows)


def test_archive_is_valid_and_nested_rows_hold_everything(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w")
    X.write_captures(spark.createDataFrame(ROWS[:1] + ROWS[7:9], PAGES).coalesce(1), path)
    whole = b"".join(gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and whole.endswith(b"\r\n\r\n") and whole.count(b"WARC-Concurrent-To: <urn:uuid:") == 6
    rows = {r["metadata"]["fields"]["page-id"]: r for r in X.transactions(X.read_records(spark, path)).collect()}
    assert set(rows) == {"1", "7", "8"}
    one = rows["1"]
    assert one["request"]["payload"] == b"" and one["request"]["target_uri"] == "http://a/b?c#d" and one["response"]["payload"].decode() == ROWS[0][2]
    assert rows["7"]["response"]["type"] == "revisit" and rows["7"]["response"]["refers_to"] == rows["8"]["capture_id"]
    assert one["request"]["concurrent_to"] == one["metadata"]["concurrent_to"] == one["response"]["record_id"] == one["capture_id"]


def test_records_that_name_no_other_are_their_own(spark):
    archive = spark.createDataFrame([("a", "response", None), ("b", "request", "a"), ("w", "warcinfo", None), ("m", "metadata", "gone"), ("c", "conversion", None)], "record_id string, type string, concurrent_to string")
    archive = archive.withColumns({"target_uri": F.lit("u"), "payload": F.lit("p")})
    got = {r["capture_id"]: (r["request"] is not None, r["response"] is not None, r["metadata"] is not None) for r in X.transactions(archive).collect()}
    assert got == {"a": (True, True, False), "w": (False, False, False), "gone": (False, False, True), "c": (False, False, False)}


def test_reader_puts_cut_blocks_together_and_leaves_out_cut_off_ones():
    def record(body):
        return f"WARC-Type: resource\r\nWARC-Record-ID: <r>\r\nX:  a\r\n  b\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode()

    bodies = ["one", CUT, "", "two" + CUT + "three" + CUT]
    text = b"".join(X.VERSION.encode() + record(b) + X.BOUNDARY.encode() for b in bodies)
    pieces = text.split(CUT.encode())
    got = list(X.records([("f", p) for p in pieces] + [("g", X.VERSION.encode() + record("longer")[:-3]), ("h", X.VERSION.encode() + record("end"))]))
    assert [b.decode() for _, b in got] == [*bodies, "end"] and got[0][0]["x"] == "a b"


def test_base32_digest(spark):
    texts = ["", "a", "é" * 99, "x" * 12_345]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.base32_sha1(F.col("t").cast("binary")).alias("d"))
    assert all(r["d"] == base64.b32encode(hashlib.sha1(r["t"].encode()).digest()).decode() for r in df.collect())


def test_empty_table(spark):
    assert captured(empty(spark, PAGES)) == []
