"""Blocks of documents, and the exchange of their hash keys.

Corpus-wide facts about word sequences (how often, in which document first)
are found without a shuffled row per occurrence: a *block* of documents sends
each of its distinct keys once, cut into ranges of the hash space (*buckets*);
a bucket gathers the keys of all blocks and replies per block.  A frequent
sequence costs one entry per block, however many documents hold it, and a
bucket's share of the hash space shrinks as the corpus grows.

The block table is written once to the shared folder, so that every phase
sees the same blocks, whatever is lost or recomputed between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readpaths.llm.shared import bounded_batches, give_back, stored
from readpaths.llm.words import U64, row_ranges, utf8

BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 200_000
BUCKET_BYTES = 4 << 20  # text per bucket
LEAST_BUCKETS = 64

REQUEST = "bucket int, block long, kind int, n int, keys binary, v1 binary, v2 binary"
REPLY = "block long, bucket int, kind int, n int, v binary"


@dataclass
class Block:
    """Rows of one block: ``meta`` (struct array of the other columns), text bytes and row offsets."""

    block: int
    meta: pa.StructArray
    buf: np.ndarray
    offsets: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.meta.field(self.meta.type.get_field_index(name))

    def texts(self) -> Iterator[bytes]:
        raw = self.buf.tobytes()
        at = self.offsets.tolist()
        return (raw[a:b] for a, b in zip(at, at[1:], strict=False))

    def pieces(self, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, bytes, offsets) of consecutive row ranges."""
        for i, j in row_ranges(self.offsets, max_bytes):
            a, b = self.offsets[i], self.offsets[j]
            yield i, j, self.buf[a:b], self.offsets[i : j + 1] - a


def block_table(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``docs`` in input order, about ``block_bytes`` of text to a row, stored.

    ``block, raw`` (bytes of text), ``meta`` (array of structs of the other
    columns, as they are), ``sizes`` and ``text`` (zstd).  A null text counts
    as empty.  A block never spans two input partitions.
    """
    bounded_batches(docs.sparkSession)
    others = T.StructType([f for f in docs.schema if f.name != text_col])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("raw", T.LongType()),
                           T.StructField("meta", T.ArrayType(others)), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, held_bytes, held_rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush():
            nonlocal serial, held, held_bytes, held_rows
            texts, metas = zip(*held, strict=True)
            sizes = np.concatenate([np.diff(o) for _, o in texts])
            raw = b"".join(b.tobytes() for b, _ in texts)
            meta = pa.concat_arrays(metas)
            out = pa.RecordBatch.from_arrays([
                pa.array([serial], pa.int64()), pa.array([len(raw)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(meta)], pa.int32()), meta),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes, pa.int64())),
                pa.array([pa.compress(raw, codec="zstd", asbytes=True) if raw else b""], pa.binary()),
            ], names=["block", "raw", "meta", "sizes", "text"])
            serial, held, held_bytes, held_rows = serial + 1, [], 0, 0
            return out

        for b in batches:
            buf, offsets = utf8(b.column(text_col))
            meta = pa.StructArray.from_arrays([b.column(n) for n in others.names], names=others.names)
            for i, j in row_ranges(offsets, block_bytes):
                size = int(offsets[j] - offsets[i])
                if held and (held_bytes + size > block_bytes or held_rows + j - i > block_rows):
                    yield flush()
                held.append(((buf[offsets[i] : offsets[j]].copy(), offsets[i : j + 1] - offsets[i]), meta.slice(i, j - i)))
                held_bytes, held_rows = held_bytes + size, held_rows + j - i
            give_back()
        if held:
            yield flush()

    return stored(docs.mapInArrow(run, schema), "blocks")


def open_block(row: dict) -> Block:
    raw = pa.decompress(row["text"], decompressed_size=row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    return Block(row["block"], row["meta"], np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(sizes))))


def open_blocks(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    """The blocks of Arrow rows of the block table."""
    for b in [batch] if isinstance(batch, pa.RecordBatch) else batch.to_batches():
        for i in range(b.num_rows):
            yield open_block({"block": b.column("block")[i].as_py(), "raw": b.column("raw")[i].as_py(), "meta": b.column("meta")[i].values,
                              "sizes": b.column("sizes")[i].values.to_numpy(zero_copy_only=False), "text": b.column("text")[i].as_py()})


def map_blocks(table: DataFrame, each: Callable[[Block], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``each`` over every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in open_blocks(b):
                yield from each(block)
            give_back()

    return table.mapInArrow(run, schema)


def map_replied(table: DataFrame, replies: DataFrame, each: Callable[[Block, dict[int, list]], pa.Table], schema) -> DataFrame:
    """``each(block, replies by kind)`` over every block; replies come in the order of the sent keys."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by_kind: dict[int, list] = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
            by_kind.setdefault(r["kind"], []).append((r["n"], r["v"]))
        give_back()
        return pa.concat_tables([each(block, by_kind) for block in open_blocks(left)])

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def bucket_bits(table: DataFrame) -> int:
    """Leading hash bits that name a bucket, from the corpus's size."""
    total = table.agg(F.sum("raw")).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES) - 1).bit_length() if total > BUCKET_BYTES * LEAST_BUCKETS else LEAST_BUCKETS.bit_length() - 1


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, byte planes apart, zstd."""
    if not len(values):
        return b""
    wide = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, -(-int(wide.max()).bit_length() // 8))
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=U64)
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U64, copy=False)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    steps = np.diff(keys, prepend=U64(0))
    head = int(steps[0])
    steps[0] = 0
    return head.to_bytes(8, "little") + pack(steps)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    steps = unpack(data[8:], n)
    steps[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(steps, dtype=U64)


def requests(block: int, kind: int, keys: np.ndarray, bits: int, v1: np.ndarray | None = None,
             v2: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Ascending distinct ``keys`` with their values, a row to each bucket that has any."""
    if not len(keys):
        return
    bucket = (keys >> U64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    rows = {k: [] for k in ("bucket", "block", "kind", "n", "keys", "v1", "v2")}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for name, value in (("bucket", int(bucket[a])), ("block", block), ("kind", kind), ("n", b - a), ("keys", pack_keys(keys[a:b])),
                            ("v1", pack(v1[a:b]) if v1 is not None else None), ("v2", pack(v2[a:b]) if v2 is not None else None)):
            rows[name].append(value)
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "v1": pa.binary(), "v2": pa.binary()}
    yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))


@dataclass
class Gathered:
    """A bucket's entries: distinct ``keys``; for each entry its key's index, values and request row."""

    keys: np.ndarray
    which: np.ndarray
    v1: np.ndarray | None
    v2: np.ndarray | None
    request: np.ndarray


def gather(table: pa.Table) -> Gathered:
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([unpack_keys(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
    found, which = np.unique(keys, return_inverse=True)

    def values(name):
        got = table.column(name).to_pylist()
        return None if got[0] is None else np.concatenate([unpack(v, n) for v, n in zip(got, sizes, strict=True)])

    return Gathered(found, which, values("v1"), values("v2"), np.repeat(np.arange(len(sizes)), sizes))


def replies(table: pa.Table, values: np.ndarray) -> pa.Table:
    """One reply per request row; ``values`` has an unsigned integer per entry."""
    sizes = np.array(table.column("n").to_pylist())
    ends = np.cumsum(sizes)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": table.column("kind"), "n": table.column("n"),
                     "v": pa.array([pack(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())})


def replied(parts: list[tuple[int, bytes]] | None) -> np.ndarray:
    """All values of one kind, in the order of the sent keys."""
    return np.concatenate([unpack(v, n) for n, v in parts]) if parts else np.zeros(0, dtype=U64)
