"""Substring de-duplication by seed and extend.

Seeds are winnowed anchors: of every ``min_words - anchor_words + 1``
consecutive ``anchor_words``-word hashes the smallest is one, so any repeat
of ``min_words`` words shares an anchor.  Documents are joined on their
anchors; an anchor that two documents share is a seed.  A seed is extended
both ways to every ``min_words``-word window around it, and a window is
confirmed when the same word sequence starts in a document with a smaller id.
Runs of overlapping confirmed windows are the maximal repeats over the
length threshold; their words are removed.

Extension compares hashes of whole windows with the smallest id that holds
them instead of walking pairs of documents, so a passage that a third of all
documents share costs one entry per block of documents, not a pair for every
two.  All windows are judged on the input, not on what is left of it.

Cases: null or empty texts have no words; a null id counts as larger than
any other, so such a row loses what it shares with a row that has an id, and
rows with equal ids (repeated rows) never remove from each other; texts
shorter than ``min_words`` words lose nothing; an empty table gives an empty
result; other columns stay as they are (a clashing name is overwritten).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readpaths.llm import blocks as bl
from readpaths.llm.words import U64, find_words, mix, window_hashes, window_starts

MIN_WORDS = 50
ANCHOR_WORDS = 10
PIECE_BYTES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = np.iinfo(np.int64).max


def sliding(best, values: np.ndarray, k: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``k`` consecutive values."""
    have, out = 1, values
    while 2 * have <= k:
        out, have = best(out[:-have], out[have:]), 2 * have
    rest = k - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, first: np.ndarray, min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed anchors."""
    whole = window_starts(first, min_words)
    grams = window_hashes(hashes, anchor_words)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    span = min_words - anchor_words + 1
    least = np.where(whole, sliding(np.minimum, grams, span), U64(0))
    edge = np.zeros(span - 1, dtype=U64)
    most = sliding(np.maximum, np.concatenate((edge, least, edge)), span)
    at = np.flatnonzero((grams == most) & (most > 0))
    return at, mix(grams[at])  # winnowed hashes are small ones; mixed they fill all buckets alike


class _Text:
    """Word hashes of a block and the number of the row of each word."""

    def __init__(self, block: bl.Block, id_col: str):
        hashes, counts = [], []
        for _, _, buf, offsets in block.pieces(PIECE_BYTES):
            found = find_words(buf, offsets)
            hashes.append(found.hashes)
            counts.append(np.diff(found.first))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        ids = block.column(id_col)
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.id_of_word = np.repeat(self.ids, self.counts)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending with their smallest and largest id."""
    order = np.argsort(keys, kind="stable")
    ordered, by = keys[order], ids[order]
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[head], np.minimum.reduceat(by, head), np.maximum.reduceat(by, head)


def _shift(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned integers of the same order; those from 0 up stay small."""
    return (ids.astype(U64) ^ U64(1 << 63)) if (ids < 0).any() else ids.astype(U64)


def _signed(values: np.ndarray, wide: np.ndarray) -> np.ndarray:
    return np.where(wide == 1, (values ^ U64(1 << 63)).astype(np.int64), values.astype(np.int64))


def _without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """``text`` without the words of ``spans`` and the white space after each."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    at, parts = 0, []
    for s in spans:
        parts.append(text[at : starts[s["start"]]])
        at = starts[s["end"]]
    return b"".join([*parts, text[at:]]).rstrip(b" \t\n\v\f\r")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
            anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Other columns of ``docs``, then ``n_words, n_removed, spans`` (removed word ranges ``start, end``),
    ``kept_sha256`` (of the kept words joined by one space) and ``text`` under its own name: the input text
    without the removed words and the white space after each of them."""
    if not 1 <= anchor_words <= min_words:
        raise ValueError("anchor_words must be from 1 to min_words")
    table = bl.block_table(docs.withColumn(id_col, F.col(id_col).cast("long")), text_col)
    bits = bl.bucket_bits(table)

    def seeds(block: bl.Block) -> Iterator[pa.RecordBatch]:
        t = _Text(block, id_col)
        at, keys = anchors(t.hashes, t.first, min_words, anchor_words)
        if len(at):
            found, low, high = _least(keys, t.id_of_word[at])
            yield from bl.requests(block.block, 0, found, bits, _shift(low), (low != high) + 2 * (low < 0).any())

    def shared(group: pa.Table) -> pa.Table:
        """1 for anchors held by two ids or more."""
        g = bl.gather(group)
        ids = _signed(g.v1, (g.v2 >> U64(1)))
        low, high = np.full(len(g.keys), NO_ID), np.full(len(g.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, g.which, ids)
        np.maximum.at(high, g.which, ids)
        many = low != high
        np.logical_or.at(many, g.which, (g.v2 & U64(1)).astype(bool))
        return bl.replies(group, many[g.which].astype(U64))

    def candidates(t: _Text, reply: np.ndarray) -> np.ndarray:
        """Starts of the windows around seeds."""
        at, keys = anchors(t.hashes, t.first, min_words, anchor_words)
        if not len(at):
            return at
        is_seed = reply[np.searchsorted(np.unique(keys), keys)].astype(bool)
        seen = np.zeros(len(t.hashes) + 1, np.int64)
        seen[at[is_seed] + 1] = 1
        seen = np.cumsum(seen)
        inside = window_starts(t.first, min_words)
        starts = np.arange(len(inside))
        return starts[inside & (seen[starts + min_words - anchor_words + 1] > seen[starts])]

    def extend(block: bl.Block, replies: dict[int, list]) -> pa.Table:
        t = _Text(block, id_col)
        starts = candidates(t, bl.replied(replies.get(0)))
        out = [pa.RecordBatch.from_arrays([*(pa.array([], x) for x in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                          names=["bucket", "block", "kind", "n", "keys", "v1", "v2"])]
        if len(starts):
            found, low, _ = _least(window_hashes(t.hashes, min_words)[starts], t.id_of_word[starts])
            out += bl.requests(block.block, 1, found, bits, _shift(low), np.full(len(low), 2 * (low < 0).any()))
        return pa.Table.from_batches(out)

    def earlier(group: pa.Table) -> pa.Table:
        """1 for windows that a smaller id than the block's smallest holds."""
        g = bl.gather(group)
        ids = _signed(g.v1, (g.v2 >> U64(1)))
        low = np.full(len(g.keys), NO_ID)
        np.minimum.at(low, g.which, ids)
        return bl.replies(group, (low[g.which] < ids).astype(U64))

    names = [f.name for f in docs.schema if f.name not in (text_col, "n_words", "n_removed", "spans", "kept_sha256")]
    kinds = {f.name: f for f in table.schema["meta"].dataType.elementType}
    result = T.StructType([*(kinds[n] for n in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("kept_sha256", T.StringType()), T.StructField(text_col, T.StringType())])

    def remove(block: bl.Block, replies: dict[int, list]) -> pa.Table:
        t = _Text(block, id_col)
        covered = np.zeros(len(t.hashes) + 1, np.int32)
        starts = candidates(t, bl.replied(replies.get(0)))
        if len(starts):
            keys, ids = window_hashes(t.hashes, min_words)[starts], t.id_of_word[starts]
            found, low, _ = _least(keys, ids)
            which = np.searchsorted(found, keys)
            gone = starts[bl.replied(replies.get(1))[which].astype(bool) | (ids > low[which])]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + min_words, -1)
        covered = np.cumsum(covered[:-1]) > 0
        removed, spans, shas, kept_texts = [], [], [], []
        bounds = t.first.tolist()
        for a, b, text in zip(bounds, bounds[1:], block.texts(), strict=False):
            words, own = text.split(), covered[a:b]
            if own.any():
                step = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
                words = [w for w, gone in zip(words, own.tolist(), strict=True) if not gone]
            else:
                spans.append([])
            removed.append(b - a - len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept_texts.append(_without(text, spans[-1]) if removed[-1] else text)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([*(block.column(n) for n in names), pa.array(t.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span),
                         pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())], names=result.names)

    seeds_of = bl.map_blocks(table, seeds, bl.REQUEST).groupBy("bucket").applyInArrow(shared, bl.REPLY)
    seeds_of = bl.stored(seeds_of, "seeds")
    windows = bl.map_replied(table, seeds_of, extend, bl.REQUEST).groupBy("bucket").applyInArrow(earlier, bl.REPLY)
    return bl.map_replied(table, seeds_of.union(windows), remove, result)
