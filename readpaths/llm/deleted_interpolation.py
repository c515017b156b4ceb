"""Language-model scoring by deleted interpolation.

``P(w | v)`` mixes the maximum-likelihood bigram and unigram estimates and a
uniform one, with weights that depend on how often the context ``v`` was seen
(buckets of powers of two).  The weights come from expectation-maximisation on
held-out counts: one fold of the training rows is deleted from the counts and
predicted by the rest; the scores then use the counts of all training rows.

Counts cover every training row.  Blocks of documents send their distinct
words and bigrams once each (see ``blocks``), so a frequent word is one entry
per block; the scores come back to the block that holds the text.  EM runs on
the deleted fold's rows in the shared folder, a sum per context bucket a round.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end
token; the first token's context is a start mark that is never a token.

Cases: a null or empty text is the end token alone; a null id counts as the
empty text in the fold's checksum; repeated rows are counted and scored as
often as they occur; without any training row (or deleted row) the weights
stay those of the prior; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.llm import blocks as bl
from readpaths.llm.shared import stored
from readpaths.llm.words import LOWER, U64, find_words, mix

FOLDS = 7
HELD_OUT_FOLD = 2  # never learned from
DELETED_FOLD = 3  # of the training folds, the one whose counts train the weights
ROUNDS = 12
PRIOR = 1.0  # pseudo-count of each weight in each bucket
PIECE_BYTES = 1 << 20
UNIGRAM, BIGRAM = 0, 1
START, END = U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)  # keys of the two marks
BUCKETS = 48  # by the context's count: 0, 1, 2-3, 4-7, ...


def bigram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * U64(0xC2B2AE3D27D4EB4F) + mix(word ^ U64(0x165667B19E3779F9)))


class _Tokens:
    """Token keys of a block in order, each with its context; ``last`` has each row's end token."""

    def __init__(self, block: bl.Block):
        parts, counts = [], []
        for _, _, buf, offsets in block.pieces(PIECE_BYTES):
            found = find_words(LOWER[buf], offsets)
            size = np.diff(found.first) + 1
            ends = np.cumsum(size) - 1
            tokens = np.empty(int(size.sum()), dtype=U64)
            inside = np.ones(len(tokens), dtype=bool)
            inside[ends] = False
            tokens[inside], tokens[ends] = found.hashes, END
            parts.append(tokens)
            counts.append(size)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.last = np.cumsum(self.size) - 1
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.last - self.size + 1] = START
        self.bigrams = bigram_keys(self.context, self.tokens)
        self.fold = np.asarray(block.column("fold").to_numpy(zero_copy_only=False), dtype=np.int64)

    def of_fold(self) -> np.ndarray:
        """Per token: 0 scored only, 1 trained on, 2 trained on and deleted."""
        role = np.where(self.fold == HELD_OUT_FOLD, 0, np.where(self.fold == DELETED_FOLD, 2, 1))
        return np.repeat(role, self.size)


def _count(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(keys, return_inverse=True)
    return found, np.bincount(which, weights=weight, minlength=len(found)).astype(np.int64)


@dataclass
class Corpus:
    """Totals: ``tokens`` and distinct ``types`` of the training rows."""

    tokens: int
    types: int


def _send(block: bl.Block, bits: int) -> Iterator[pa.RecordBatch]:
    """Each distinct key once: v1 its training count, v2 the part of it that is deleted.

    Folds never share a block, so v2 is either zero or v1 throughout.
    """
    t = _Tokens(block)
    role = int(t.of_fold()[0]) if len(t.tokens) else 0
    starts = np.full(len(t.size), START)
    for kind, keys in ((UNIGRAM, np.concatenate((t.tokens, starts))), (BIGRAM, t.bigrams)):
        found, counts = _count(keys)
        yield from bl.requests(block.block, 2 * kind + (role == 2), found, bits, counts if role else np.zeros(len(found), np.int64),
                               np.full(1, role == 2, np.int64).repeat(len(found)))


def _sum(group: pa.Table) -> pa.Table:
    """Training counts for every key; to deleted rows' blocks also the count without them."""
    out = []
    table = group.append_column("gram", pa.array([k // 2 for k in group.column("kind").to_pylist()]))
    for gram in (UNIGRAM, BIGRAM):
        part = table.filter(pc.equal(table.column("gram"), gram)).drop_columns(["gram"])
        if not part.num_rows:
            continue
        g = bl.gather(part)
        counts = g.v1.astype(np.int64)
        every = np.bincount(g.which, weights=counts, minlength=len(g.keys)).astype(np.int64)
        core = np.bincount(g.which, weights=counts * (g.v2 == 0), minlength=len(g.keys)).astype(np.int64)
        reply = bl.replies(part, every[g.which].astype(U64))
        deleted = part.filter(pc.equal(pc.bit_wise_and(part.column("kind"), 1), 1))
        token = (g.keys != START) & (every > 0) if gram == UNIGRAM else np.zeros(len(g.keys), bool)
        core_token = (g.keys != START) & (core > 0) if gram == UNIGRAM else token
        facts = [int(every[token].sum()), int(token.sum()), int(core[core_token].sum()), int(core_token.sum())]
        reply = reply.set_column(2, "kind", pa.array([gram] * reply.num_rows, pa.int32()))
        for i, name in enumerate(("tokens", "types", "core_tokens", "core_types")):
            reply = reply.append_column(name, pa.array([facts[i]] + [0] * (reply.num_rows - 1), pa.int64()))
        out.append(reply)
        if deleted.num_rows:
            at = np.isin(g.request, np.flatnonzero(np.array(part.column("kind").to_pylist()) % 2 == 1))
            less = bl.replies(deleted, core[g.which[at]].astype(U64))
            less = less.set_column(2, "kind", pa.array([2 + gram] * less.num_rows, pa.int32()))
            for name in ("tokens", "types", "core_tokens", "core_types"):
                less = less.append_column(name, pa.array([0] * less.num_rows, pa.int64()))
            out.append(less)
    return pa.concat_tables(out)


_SUMS = bl.REPLY + ", tokens long, types long, core_tokens long, core_types long"


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _counts(t: _Tokens, replies: dict[int, list], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: counts of its context, of the token and of the bigram."""
    # the start mark goes last, so that a context is the entry before its token, or the last one
    _, slot = np.unique(np.concatenate((t.tokens, np.full(min(1, len(t.size)), START))), return_inverse=True)
    one = bl.replied(replies.get(kind + UNIGRAM)).astype(np.int64)[slot]
    _, slot = np.unique(t.bigrams, return_inverse=True)
    two = bl.replied(replies.get(kind + BIGRAM)).astype(np.int64)[slot]
    word, context = one[:-1], np.concatenate((one[-1:], one[:-2]))
    context[t.last - t.size + 1] = one[-1:] if len(t.size) else 0
    return context, word, two


def fit_weights(rows: DataFrame, core: Corpus, rounds: int = ROUNDS) -> np.ndarray:
    """EM over stored ``bucket, c_context, c_word, c_pair, n`` rows: weights (bucket x bigram, unigram, uniform).

    Bucket 0 holds contexts never seen, which have no bigram estimate: its bigram weight is 0.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 1 / 2, 1 / 2
    uniform = 1.0 / (core.types + 1)
    for _ in range(rounds):
        lam = [F.get(F.array(*[F.lit(float(w)) for w in weights[:, i]]), F.col("bucket")) for i in range(3)]
        bi = lam[0] * F.when(F.col("c_context") > 0, F.col("c_pair") / F.col("c_context")).otherwise(0.0)
        uni = lam[1] * (F.col("c_word") / F.lit(float(max(core.tokens, 1))))
        flat = lam[2] * F.lit(uniform)
        parts = rows.select("bucket", "n", bi.alias("bi"), uni.alias("uni"), flat.alias("flat")).withColumn("all", F.col("bi") + F.col("uni") + F.col("flat"))
        sums = parts.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(c) / F.col("all")).alias(c) for c in ("bi", "uni", "flat")]).collect()
        expected = np.full((BUCKETS, 3), PRIOR)
        expected[0, 0] = 0
        for r in sums:  # at most BUCKETS rows
            expected[r["bucket"]] += (r["bi"], r["uni"], r["flat"])
        weights = expected / expected.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.alias("fold"))
    # one block table per role: deleted rows never share a block with others
    deleted = F.col("fold") == DELETED_FOLD
    held = F.col("fold") == HELD_OUT_FOLD
    tables = [bl.block_table(kept.where(x)) for x in (~deleted & ~held, deleted, held)]
    offset = [t.withColumn("block", F.col("block") * 4 + i) for i, t in enumerate(tables)]
    table = offset[0].union(offset[1]).union(offset[2])
    bits = bl.bucket_bits(table)
    sums = stored(bl.map_blocks(table, lambda b: _send(b, bits), bl.REQUEST).groupBy("bucket").applyInArrow(_sum, _SUMS), "counts")
    totals = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "core_tokens", "core_types")]).first()
    corpus, core = Corpus(totals["tokens"], totals["types"]), Corpus(totals["core_tokens"], totals["core_types"])
    answers = sums.select("block", "bucket", "kind", "n", "v")

    def held_out_counts(block: bl.Block, replies: dict[int, list]) -> pa.Table:
        t = _Tokens(block)
        context, word, pair = _counts(t, replies, 2)
        seen = np.stack((context, word, pair), axis=1)
        order = np.lexsort(seen.T)
        seen = seen[order]
        head = np.flatnonzero(np.concatenate(([True], (seen[1:] != seen[:-1]).any(axis=1)))) if len(seen) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(seen)))
        seen = seen[head]
        return pa.table({"bucket": pa.array(_bucket(seen[:, 0]), pa.int32()), "c_context": seen[:, 0], "c_word": seen[:, 1], "c_pair": seen[:, 2], "n": pa.array(n, pa.int64())})

    rows = stored(bl.map_replied(offset[1], answers.where("kind >= 2"), held_out_counts,
                                 "bucket int, c_context long, c_word long, c_pair long, n long"), "held-out")
    weights = fit_weights(rows, core, rounds)

    def log_probabilities(block: bl.Block, replies: dict[int, list]) -> pa.Table:
        t = _Tokens(block)
        context, word, pair = _counts(t, replies, 0)
        # without any training token only the uniform estimate is one
        lam = weights[_bucket(context)] if corpus.tokens else np.tile([0.0, 0.0, 1.0], (len(context), 1))
        p = lam[:, 0] * (pair / np.maximum(context, 1)) + lam[:, 1] * (word / max(corpus.tokens, 1)) + lam[:, 2] / (corpus.types + 1)
        begin = t.last - t.size + 1
        base = np.log10((word + 1) / (corpus.tokens + (corpus.types + 1)))

        def per_row(values):
            return np.add.reduceat(values, begin) if len(begin) else values

        return pa.table([block.column("id"), pa.array(t.fold == HELD_OUT_FOLD), pa.array(t.size, pa.int64()), pa.array(per_row((word > 0).astype(np.int64)), pa.int64()),
                         pa.array(np.full(len(t.size), corpus.tokens), pa.int64()), pa.array(per_row(base), pa.float64()), pa.array(per_row(np.log10(p)), pa.float64())],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = bl.map_replied(table, answers.where("kind < 2"), log_probabilities,
                         f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
