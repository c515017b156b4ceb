"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are merged by a queue with a bucket for each merge rank.  A bucket
holds positions of a linked list of tokens (arrays of next and previous
positions); a bitmap of three or more levels tells by find-first-set which
lowest bucket has entries; entries whose pair has changed since are stale and
skipped.  All pre-tokens of a batch share one queue: lists of different
pre-tokens never touch, so each pop merges a whole bucket in one vectorised
step, and a very long pre-token costs about its length, not its square.

Within a pre-token the order is the library's: lowest rank first, leftmost on
ties.  Should a merge create a pair of a *lower* rank, the pre-token's later
entries of the bucket go back into it, and that pair comes first.

Vocabulary: a rank file (``base64 token, space, rank`` a line; the id of a
token is its rank), read by the driver and sent to the tasks -- its size is
fixed by the file, not by the data.

Cases: null and empty texts have no tokens; repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readpaths.llm.shared import bounded_batches, give_back

NONE = np.int64(1) << 40  # rank of a pair that never merges
KNOWN_WORDS = 80_000  # words of either of two generations that a worker keeps encoded; all are encoded, kept or not
KNOWN_CHARS = 64       # longer words are not kept
PIECE_CHARS = 3_000_000
ROW_DOCS = 20_000
# A space inside a longer run of white space may belong to another pre-token than the word after it.
_WIDE_SPACE = re.compile(r" \s|\s ")


class RankQueue:
    """Buckets of positions by rank; ``pop`` returns the lowest non-empty one."""

    def __init__(self, ranks: int):
        self.levels = []
        size = ranks
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.concatenate(([0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(ranks)])).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            rank = int(ranks[a])
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [positions[a:b]]
                at = rank
                for level in self.levels:
                    before = level[at >> 6]
                    level[at >> 6] = before | (1 << (at & 63))
                    if before:
                        break
                    at >>= 6
            else:
                bucket.append(positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        word = self.levels[-1][0]
        if not word:
            return None
        rank = (word & -word).bit_length() - 1
        for level in reversed(self.levels[:-1]):
            word = level[rank]
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        parts = self.buckets.pop(rank)
        return rank, np.sort(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])


class Vocabulary:
    """Tokens by id, and the rank of every pair of tokens whose concatenation is a token."""

    def __init__(self, rank_file: bytes):
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.ids = ids
        self.size = max(ids.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = token
        self.of_byte = np.array([ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")

    @functools.cached_property
    def decimals(self) -> list[bytes]:
        return [str(i).encode() for i in range(self.size)]

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (ascending) of all pairs that merge, and their ranks; only encoding needs them."""
        keys, ranks = array("q"), array("q")
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 24 | right)
                    ranks.append(rank)
        keys, ranks = np.frombuffer(keys, np.int64), np.frombuffer(ranks, np.int64)
        order = np.argsort(keys)
        return keys[order], ranks[order]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 24 | right
        pairs, ranks = self.pairs
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        return np.where(pairs[at] == keys, ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes = np.where(whole >= 0, 1, np.fromiter(map(len, pieces), np.int64, len(pieces)))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        n = len(owner)
        token = np.empty(n, np.int64)
        single = whole[owner] >= 0
        token[single] = whole[whole >= 0]
        token[~single] = self.of_byte[np.frombuffer(b"".join(p for p, w in zip(pieces, whole.tolist(), strict=True) if w < 0), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            edge = np.flatnonzero(owner[1:] != owner[:-1])
            after[edge], before[edge + 1] = -1, -1
            after[-1] = -1
        current = np.full(n, NONE)
        linked = np.flatnonzero(after >= 0)
        current[linked] = self.rank(token[linked], token[linked + 1])
        queue = RankQueue(self.size)
        ready = np.flatnonzero(current < NONE)
        queue.push(current[ready], ready)
        alive = np.ones(n, bool)
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[current[at] == rank]  # others are stale
            if len(at):
                self._merge(rank, at, token, after, before, current, alive, owner, queue)
        counts = np.bincount(owner[alive], minlength=len(pieces))
        return token[alive], counts

    def _merge(self, rank, at, token, after, before, current, alive, owner, queue) -> None:
        """Merge the pairs of ``rank`` at the ascending positions ``at``, left to right."""
        if len(at) > 1:  # of overlapping pairs (equal tokens in a row) every second one merges
            follows = np.zeros(len(at), bool)
            follows[1:] = after[at[:-1]] == at[1:]
            if follows.any():
                index = np.arange(len(at))
                head = np.maximum.accumulate(np.where(follows, 0, index))
                at = at[(index - head) % 2 == 0]
        second = after[at]
        right, left = after[second], before[at]
        touching = np.zeros(len(at), bool)  # the left neighbour is the pair merged just before
        touching[1:] = left[1:] == second[:-1]
        ends, begins = right < 0, left < 0
        new_left = np.where(begins, NONE, self.rank(np.where(touching, rank, token[left]), np.full(len(at), rank)))
        new_right = np.where(ends, NONE, self.rank(np.full(len(at), rank), token[right]))
        lower = np.minimum(new_left, new_right) < rank
        if lower.any():  # what follows such a merge in its pre-token waits
            index = np.arange(len(at))
            start = np.concatenate(([0], np.flatnonzero(owner[at[1:]] != owner[at[:-1]]) + 1))
            first = np.minimum.reduceat(np.where(lower, index, len(at)), start)
            wait = index > np.repeat(first, np.diff(np.append(start, len(at))))
            queue.push(np.full(int(wait.sum()), rank), at[wait])
            go = ~wait
            at, second, right, left, touching, new_left, new_right = (x[go] for x in (at, second, right, left, touching, new_left, new_right))
            ends, begins = right < 0, left < 0
        token[at] = rank
        alive[second] = False
        current[second] = NONE
        after[at] = right
        before[right[~ends]] = at[~ends]
        current[at] = new_right
        if touching.any():
            pair = np.flatnonzero(touching)
            current[at[pair - 1]] = self.rank(np.full(1, rank), np.full(1, rank))[0]
        free = ~begins & ~touching
        current[left[free]] = new_left[free]
        changed = np.concatenate((at, left[free]))
        changed = changed[current[changed] < NONE]
        queue.push(current[changed], changed)


class Encoder:
    """Texts to ids; keeps recent words encoded.

    A pre-token holds a space only at its start, so single spaces part a text
    into words whose pre-tokens are those of the text.  A text with longer runs
    of white space around a space is cut by the pattern itself.  The pre-tokens
    of all new words of a call go through one queue.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(rank_file), regex.compile(pattern)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if _WIDE_SPACE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Keep the ids of new words; those of words too long to be kept are returned."""
        cut = [self.pattern.findall(w) for w in fresh]
        pieces = list({p for found in cut for p in found})
        ids, sizes = self.vocabulary.encode([p.encode() for p in pieces])
        flat, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
        known = {p: flat[a:b] for p, a, b in zip(pieces, [0, *ends], ends, strict=False)}
        long = {}
        for w, found in zip(fresh, cut, strict=True):
            (self.new if len(w) <= KNOWN_CHARS else long)[w] = known[w] if len(found) == 1 and found[0] == w else b"".join(map(known.__getitem__, found))
        return long

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.new) > KNOWN_WORDS:
            self.old, self.new = self.new, {}
        # words are numbered as they come, so that only one text's words are held at a time
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        numbers = [array("i", map(number.__getitem__, self.words(t))) for t in texts]
        fresh = []
        for w in number:
            if w in self.old:
                self.new[w] = self.old[w]
            elif w not in self.new:
                fresh.append(w)
        long = self._learn(fresh)
        ids = [self.new[w] if w in self.new else long[w] for w in number]
        parts = [b"".join(map(ids.__getitem__, x)) for x in numbers]
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(rank_file, pattern)
    return _ENCODERS[key]


def _ranges(sizes: list[int], limit: int, rows: int) -> Iterator[tuple[int, int]]:
    i = held = 0
    for j, size in enumerate(sizes):
        if j > i and (held + size > limit or j - i >= rows):
            yield i, j
            i, held = j, 0
        held += size
    if i < len(sizes):
        yield i, len(sizes)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``ids`` (array of int) of the texts, one row per input row."""
    bounded_batches(docs.sparkSession)
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    through = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _ranges([len(t) for t in texts], PIECE_CHARS, ROW_DOCS):
                ids, counts = encoder(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in through), lists], names=[*through, "ids"])
            give_back()

    named = docs.select(*[F.col(f"`{c}`").alias(t) for c, t in zip(carry, through, strict=True)], F.col(text_col).alias("text"))
    schema = T.StructType([*(named.schema[t] for t in through), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return named.mapInArrow(run, schema).toDF(*carry, "ids")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The columns of ``encoded`` with ``n_tokens, ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the bytes of the ids' tokens)."""
    bounded_batches(encoded.sparkSession)
    with open(rank_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    through = [f"c{i}" for i in range(len(encoded.columns))]
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(ranks.value, pattern).vocabulary
        for b in batches:
            lists, counts, shas, texts = b.column(at), [], [], []
            flat, cuts = lists.values, lists.offsets.to_pylist()
            for a, z in zip(cuts, cuts[1:], strict=False):
                ids = flat.slice(a, z - a).to_numpy(zero_copy_only=False).tolist()
                counts.append(len(ids))
                shas.append(hashlib.sha256(b" ".join(map(vocabulary.decimals.__getitem__, ids))).hexdigest())
                texts.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                                             names=[*through, "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    named = encoded.toDF(*through)
    schema = T.StructType([*named.schema, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return named.mapInArrow(run, schema).toDF(*encoded.columns, "n_tokens", "ids_sha256", "decoded_sha256")


def decode_text(encoded: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns of ``encoded`` with ``ids`` turned back into the text."""
    with open(rank_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        vocabulary = _encoder(ranks.value, pattern).vocabulary
        return ids.map(lambda x: vocabulary.decode(x.tolist()).decode("utf-8", "replace"))

    return encoded.withColumn(text_col, text("ids")).drop("ids")
