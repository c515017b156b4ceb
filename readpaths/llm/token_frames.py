"""Token ids in binary files: one zstandard frame a document, all with one shared dictionary.

A text's ids (those of the ``tokenizers`` library, then an end id) are
serialised little-endian, two bytes an id where the vocabulary allows it, else
four.  The dictionary is trained on the serialised ids of a bounded sample of
documents; every document is compressed on its own, so any of them can be read
without its neighbours, and short ones still profit from what all have in
common.

A data set is a folder with

* ``dictionary``: the trained dictionary;
* ``data/*.bin``: ``HEADER`` (magic, bytes an id, SHA-256 of the dictionary),
  the frames, then the offset index: the frames' offsets and the end of the
  last one as 64-bit numbers, their count and where the index begins;
* ``index``: a table of ``doc_id, file, offset, length, n_tokens, start``,
  sorted by document, where ``start`` counts the ids before the document's.

Files follow the order of the ids.  A task writes files of names no other
attempt uses, and the index, which Spark commits, names only those of the
attempts that count: one left by a lost executor is never read.  Files are
opened with ``pyarrow.fs``, so the folder may be on any store that it knows
(local or mounted paths, hdfs, s3, gs, abfs).

Words between ASCII white space are encoded once and remembered: the
tokenizer's pattern never crosses white space, so a text's ids are those of
its words.  The words that a task remembers are bounded.  New words of plain
letters and marks go to the library's merge model directly, which is what its
normaliser and pattern would hand it; all others go through the whole library.
The vocabulary is one of byte-level pieces in lower case.

Cases: a null text is an empty one, of which the end id remains; a null id
sorts first; rows with equal ids are ordered by a hash of their frames, and
repeated rows are written as often as they occur; a table too small to train
on is written without a dictionary; an empty table gives an empty data set;
names of special tokens in a text are ordinary text; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readpaths.llm.shared import BATCH_BYTES, bounded_batches, stored
from readpaths.llm.words import utf8

END_ID = 1
LEVEL = 3
SAMPLE_ROWS = 2000        # documents that the dictionary is trained on, at most
SAMPLE_CHARS = 16_384     # of documents no longer than this, for the dictionary serves short ones
DICTIONARY_BYTES = 112_640
KNOWN_WORDS = 200_000     # words of either of two generations that a task remembers
KNOWN_BYTES = 64          # longer words are not remembered
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20      # neighbouring frames that are read at once
KNOWN_TAILS = 10_000
MAGIC = b"IDFRAME1"
HEADER = 8 + 4 + 32
# Letters whose composed form and lower case are their own affair, then ASCII marks without an apostrophe: the
# vocabulary's pattern cuts between the two and nowhere else.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# The characters that byte-level vocabularies write bytes as: printable ones as they are, the others from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Serialised ids of texts by a ``tokenizers`` vocabulary, word by word."""

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        small = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
        self.kind, self.code = (np.dtype("<u2"), "H") if small else (np.dtype("<u4"), "I")
        self.end = array(self.code, [end_id]).tobytes()
        self.tails: dict[str, bytes] = {}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            yield array(self.code, found.ids).tobytes()

    def _merged(self, letters: str) -> bytes:
        """Ids of letters that the tokenizer's own normaliser and pattern would leave as one piece."""
        lowered = letters.lower()
        piece = lowered if lowered.isascii() else lowered.encode().decode("latin-1").translate(BYTE_LEVEL)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Remember the ids of new words; those of words too long to be remembered are returned."""
        long, odd, new = {}, [], self.new
        for w in fresh:
            plain = PLAIN_WORD.fullmatch(w.decode()) if len(w) <= KNOWN_BYTES else None
            if not plain:
                odd.append(w)
                continue
            letters, tail = plain.groups()
            root = letters.lower().encode()
            ids = new.get(root) or self.old.get(root)
            if ids is None:
                ids = new[root] = self._merged(letters)
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = next(self._ids([tail.encode()]))
                ids += self.tails[tail]
            new[w] = ids
        for w, ids in zip(odd, self._ids(odd), strict=True):
            (new if len(w) <= KNOWN_BYTES else long)[w] = ids
        if len(self.tails) > KNOWN_TAILS:
            self.tails = {}
        return long

    def __call__(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The serialised ids of each UTF-8 text, with the end id."""
        for text in texts:
            words = text.split()  # bytes.split cuts at ASCII white space only
            if len(self.new) > KNOWN_WORDS:
                self.old, self.new = self.new, {}
            fresh = []
            for w in set(words).difference(self.new):
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    fresh.append(w)
            long = self._learn(fresh)
            get = (self.new | long).__getitem__ if long else self.new.__getitem__
            yield b"".join(map(get, words)) + self.end


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, at = utf8(column)
    whole = data.tobytes()
    return (whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: str | None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES`` of the column ``size`` (or of 10,000 rows)."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += len(row[size]) + 64 if size else BATCH_BYTES // 10_000
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder that may be named by a URI."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def train(docs: DataFrame, vocabulary: str, end_id: int = END_ID, text_col: str = "text") -> bytes:
    """A dictionary for the ids of ``docs``, from ``SAMPLE_ROWS`` short documents at most; empty if there are too few."""
    text = F.coalesce(text_col, F.lit(""))
    short = docs.select(text.alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    n = short.count()
    mark = F.xxhash64("text", F.monotonically_increasing_id())
    sample = short.withColumn("mark", mark).where(F.pmod("mark", F.lit(max(n, 1))) < 2 * SAMPLE_ROWS).orderBy("mark").limit(SAMPLE_ROWS).select("text")

    def run(batches):
        encode = Encoder(vocabulary, end_id)
        for b in batches:
            yield pa.record_batch({"ids": pa.array(list(encode(_texts(b.column(0)))), pa.binary())})

    samples = sorted(bytes(r["ids"]) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=1024, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def frames(docs: DataFrame, vocabulary: str, dictionary: bytes, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, frame``: every document's ids, compressed on their own."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])

    def run(batches):
        encode, known = Encoder(vocabulary, end_id), _dictionary(dictionary)
        if known:
            known.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress

        def rows():
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), encode(_texts(b.column(1))), strict=True):
                    yield {"doc_id": doc_id, "n_tokens": len(ids) // encode.kind.itemsize, "frame": press(ids)}

        yield from _batches(rows(), schema, "frame")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


class _File:
    """A data file while it is written."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str, width: int, dictionary_hash: bytes):
        self.out, self.offsets = fs.open_output_stream(path), [HEADER]
        self.out.write(MAGIC + width.to_bytes(4, "little") + dictionary_hash)

    def add(self, frame: bytes) -> int:
        self.out.write(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        return self.offsets[-2]

    def close(self) -> None:
        self.out.write(np.array([*self.offsets, len(self.offsets) - 1, self.offsets[-1]], "<u8").tobytes())
        self.out.close()


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all texts of ``docs`` as a data set at ``path``, in ascending order of ``id_col``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path) as f:
        vocabulary = f.read()
    width = Encoder(vocabulary, end_id).kind.itemsize
    dictionary = train(docs, vocabulary, end_id, text_col)
    digest = hashlib.sha256(dictionary).digest()
    fs, folder = open_folder(path)
    fs.create_dir(f"{folder}/data", recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)

    made = frames(docs, vocabulary, dictionary, end_id, id_col, text_col)
    made = stored(made.withColumn("mark", F.xxhash64("frame")).withColumn("copy", F.monotonically_increasing_id()), "frames")
    keys = ("doc_id", "mark", "copy")
    placed = made.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "frame")
    names = [("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())]

    def run(batches):
        store, base = open_folder(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex

        def rows():
            number, current, before = -1, None, 0
            for b in batches:
                for doc_id, n, frame in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if current is None or current.offsets[-1] >= file_bytes:
                        if current:
                            current.close()
                        number, before = number + 1, 0
                        name = f"{part:06d}-{number:04d}-{attempt}.bin"
                        current = _File(store, f"{base}/data/{name}", width, digest)
                    at = current.add(frame)
                    yield {"doc_id": doc_id, "part": part, "number": number, "file": name, "offset": at, "length": len(frame), "n_tokens": n, "before": before}
                    before += n
            if current:
                current.close()

        yield from _batches(rows(), pa.schema(names), None)

    found = stored(placed.mapInArrow(run, "doc_id long, part int, number int, file string, offset long, length long, n_tokens long, before long"), "frame-places")
    # one row a file: tens of thousands of them at 100 TB
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    earlier = F.sum("ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("part", "number", F.coalesce(earlier, F.lit(0)).alias("first"))
    index = found.join(files, ["part", "number"])
    index = index.select("part", "number", "doc_id", "file", "offset", "length", "n_tokens", (F.col("first") + F.col("before")).alias("start"))
    index.sortWithinPartitions("part", "number", "offset").drop("part", "number").write.parquet(f"{path}/index")


def _decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of index rows, read from the files; ``ids`` are unsigned 32-bit little-endian numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        store, base = open_folder(path)
        with store.open_input_stream(f"{base}/dictionary") as f:
            dictionary = f.read()
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        digest, name, source, width = hashlib.sha256(dictionary).digest(), None, None, 0

        def pieces():
            """Runs of index rows whose frames are neighbours in a file."""
            for b in batches:
                run_, end = [], None
                for row in b.to_pylist():
                    if run_ and (row["file"] != run_[-1]["file"] or row["offset"] != end or end - run_[0]["offset"] >= READ_BYTES):
                        yield run_
                        run_ = []
                    run_.append(row)
                    end = row["offset"] + row["length"]
                if run_:
                    yield run_

        def rows_out():
            nonlocal name, source, width
            for run_ in pieces():
                first, last = run_[0], run_[-1]
                if first["file"] != name:
                    if source:
                        source.close()
                    name, source = first["file"], store.open_input_file(f"{base}/data/{first['file']}")
                    head = source.read_at(HEADER, 0)
                    if head[:8] != MAGIC or head[12:] != digest:
                        raise ValueError(f"{name} was not written with the dictionary of {path}")
                    width = int.from_bytes(head[8:12], "little")
                data = source.read_at(last["offset"] + last["length"] - first["offset"], first["offset"])
                for row in run_:
                    at = row["offset"] - first["offset"]
                    ids = np.frombuffer(unpack(data[at : at + row["length"]]), f"<u{width}").astype("<u4")
                    yield {"doc_id": row["doc_id"], "start": row["start"], "n_tokens": len(ids), "ids": ids.tobytes()}
            if source:
                source.close()

        yield from _batches(rows_out(), schema, "ids")

    return rows.select("doc_id", "file", "offset", "length", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a data set."""
    return spark.read.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a data set: ``doc_id, start, n_tokens, ids``."""
    bounded_batches(spark)
    return _decoded(index(spark, path), path)


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """Some documents of a data set; only their frames are read."""
    return _decoded(index(spark, path).where(F.col("doc_id").isin(list(doc_ids))), path)


def offsets_of(data: bytes) -> np.ndarray:
    """The offset index at the end of a whole data file."""
    n, end = np.frombuffer(data[-16:], "<u8").tolist()
    return np.frombuffer(data[end : end + 8 * (n + 1)], "<u8")
