"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a 1 in each bit that is set in over half of its
shingle hashes.  Two fingerprints link when at most ``max_bits`` bits
differ.  Links are found by the pigeonring principle: cut the 64 bits into
``max_bits + 1`` segments on a ring; if the whole difference is at most
``max_bits``, some segment starts a chain whose first ``l`` segments differ
in at most ``floor(l * max_bits / segments)`` bits for every ``l``.  The
first segment of such a chain is equal and the second differs in at most one
bit, so one of the second's halves is equal, too: the join keys are a segment
and either half of the next, about half of all bits at two bits (against 1/3
for the plain pigeonhole filter), in six rows of two numbers a fingerprint.
The chains' budgets and the full Hamming distance are tested on what a key
lets through.

Copies are collapsed first: links run between *distinct* fingerprints, and a
fingerprint has at most C(64,2) + 64 others within two bits, so no group of
copies makes a quadratic number of pairs.

Cases: a null or empty text has the fingerprint zero and links like any
other; a text of fewer words than a shingle hashes its whole sequence;
repeated rows stay repeated rows; a null id takes part, but never names a
component unless all its members have null ids; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.llm.shared import bounded_batches, give_back, stored
from readpaths.llm.words import LOWER

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    found = (text or "").encode().translate(LOWER.tobytes()).split()
    if not found:
        return 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= shingle_words:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - shingle_words + 1
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        j = min(n, i + 65536)
        spans = zip(starts[i:j].tolist(), ends[i + shingle_words - 1 : j + shingle_words - 1].tolist(), strict=True)
        hashes = np.array([h(joined[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``<id_col>, fingerprint`` (as a signed long), one row per input row."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(marks.view(np.int64))], names=["id", "fingerprint"])
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each ring segment."""
    m = max_bits + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at most ``max_bits`` (1 to 15) bits apart.

    ``marks`` has one row per distinct ``fingerprint``.
    """
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be from 1 to 15")
    ring, m = segments(max_bits), max_bits + 1
    mark = F.col("fingerprint")

    def cut(col, i):
        at, width = ring[i % m]
        return F.shiftrightunsigned(col, at).bitwiseAND(F.lit((1 << width) - 1))

    def halves(i):
        """The halves of segment ``i`` as (number, half, width) columns."""
        at, width = ring[i % m]
        low = width // 2
        for half, begin, size in ((0, at, low), (1, at + low, width - low)):
            yield half, F.shiftrightunsigned(mark, begin).bitwiseAND(F.lit((1 << size) - 1)), size

    # a key in one number: segment, which half, the segment's bits, the half's bits (at most 4 + 1 + 32 + 16 bits)
    keys = [F.shiftleft(F.shiftleft(cut(mark, i), size).bitwiseOR(bits), 5).bitwiseOR(F.lit(2 * i + half)) for i in range(m) for half, bits, size in halves(i + 1)]
    right = marks.select(mark.alias("b"), F.explode(F.array(*keys)).alias("k"))
    left = marks.select(mark.alias("a"), F.explode(F.array(*keys)).alias("k"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chains = None
    for i in range(m):  # the key proves l = 1; longer chains by their proportional budget, the last is the full distance
        spent, holds = None, F.shiftright(F.col("k").bitwiseAND(F.lit(31)), 1) == i
        for step in range(m):
            part = F.bit_count(cut(diff, i + step))
            spent = part if spent is None else spent + part
            holds = holds & (spent <= (step + 1) * max_bits // m)
        chains = holds if chains is None else chains | holds
    # pinned to a sort-merge join, so that the plan is the same at any size
    return (left.join(right.hint("merge"), "k").where((F.col("a") < F.col("b")) & chains & (F.bit_count(diff) <= max_bits))
            .select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest reachable node) of every node of the undirected ``a, b`` edges.

    Alternating large-star and small-star steps (logarithmic number of rounds
    in practice); every round is written to the shared folder, so lineage
    stays short and a lost executor costs one round at most.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("b", "a")).toDF("v", "u")
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a < b").distinct()
        down = large.toDF("u", "v")  # u < v
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = (down.join(low, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
                 .union(low.select(F.col("m").alias("a"), F.col("v").alias("b"))).where("a < b").distinct())
        now = stored(small, "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def _named(marked: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``fingerprint, root, component_id`` of every distinct fingerprint, stored."""
    classes = stored(marked.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "classes")
    roots = components(links(classes.select("fingerprint"), max_bits))
    rooted = (classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
              .withColumn("root", F.coalesce("root", "fingerprint")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``<id_col>, fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest id reachable) per row."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return marked.join(_named(marked, id_col, max_bits), "fingerprint").select(
        F.col(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row per component: that of the smallest id (one of them, if rows share it)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.col(f"`{id_col}`")
    # rows are told apart by id and content, so no copy of the table is kept and only ids and hashes go through the joins
    key = F.struct(own.isNull().alias("no_id"), own.alias("id"), F.xxhash64(*columns).alias("h"), F.hash(*columns, F.lit(1)).alias("g"))
    marked = stored(fingerprints(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", shingle_words).select("key", "key.id", "fingerprint"), "fingerprints")
    firsts = stored(marked.groupBy("fingerprint").agg(F.min("key").alias("key")), "firsts")
    roots = _named(marked, "id", max_bits).select("fingerprint", "root")
    winners = firsts.join(roots, "fingerprint").groupBy("root").agg(F.min("key").alias("key"))
    repeated = marked.groupBy("key.h", "key.g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g", F.lit(True).alias("again"))
    winners = stored(winners.select("key.h", "key.g").join(repeated, ["h", "g"], "left").select("h", "g", F.coalesce("again", F.lit(False)).alias("again")), "winners")
    # pinned to a sort-merge join: the winners grow with the table, so a plan that sends them everywhere only suits small ones
    rows = docs.select(F.xxhash64(*columns).alias("h"), F.hash(*columns, F.lit(1)).alias("g"), F.struct(*columns).alias("row"))
    kept = rows.join(winners.hint("merge"), ["h", "g"])
    once = kept.where("again").groupBy("h", "g").agg(F.first("row").alias("row")).select("row.*")
    return kept.where(~F.col("again")).select("row.*").union(once)
