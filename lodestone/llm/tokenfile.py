"""Token files: independent zstandard frames with a trailing seek table and a checksum for each frame.

Layout, all numbers little-endian:

    frame, 0x0A, frame, 0x0A, ..., index, footer, 0x0A

A frame is one zstandard frame over the ids of some whole documents, as unsigned 16-bit numbers, or 32-bit ones where an
id needs them. The index is one zstandard frame over the seek table (for each frame: offset u64, size u32, crc32 u32 of the
compressed bytes, documents u32, bytes an id u32) and then, for each document, doc_id i64, tokens u64 and has_id u8. The
footer holds the index' offset u64, size u32 and crc32 u32, frames u32, documents u64, ids u64 and the magic text.

Spark's text sink writes the rows of a partition in order, each followed by 0x0A, to any file system it knows, with its
commit protocol; hence the 0x0A after each part. A file holds about FILE_CHARS code points of text, however large the corpus,
so one fits a task's memory; rows of one doc_id, or of none, may spread over files. Files are read with the binaryFile source,
one at a time. A reader takes the footer and the index, and then decompresses only the frames that hold the requested documents.

Defined results: a null text is empty and has its end token alone; repeated documents are all written, next to each other in
the order of a hash of their texts; a null doc_id comes first; a very long text is one document of one frame; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, pieces, table
from .tokens import encoder, vocabulary

END_ID, VOCABULARY = 2, "word_bpe_49k.json"
#: A frame ends once it has so many ids.
FRAME_IDS = 1 << 16
#: Code points of text in a file, about.
FILE_CHARS = 16_000_000
MAGIC = b"LODETOK1"
_FRAME, _FOOTER = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("docs", "<u4"), ("width", "<u4")]), struct.Struct("<QIIIQQ8s")


class Writer:
    """Makes the parts of one file: add() documents, then finish()."""

    def __init__(self, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_ids, self.at, self.frames, self.keys, self.counts, self.open, self.held, self.docs = frame_ids, 0, [], [], [], [], 0, 0

    def add(self, key: int | None, ids: bytes) -> Iterator[bytes]:
        """ids: little-endian unsigned 32-bit numbers."""
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.open.append(ids)
        self.docs += 1
        self.held += len(ids) // 4
        if self.held >= self.frame_ids:
            yield self._close()

    def _close(self) -> bytes:
        ids = np.frombuffer(b"".join(self.open), "<u4")
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        part = self.press.compress(ids.astype(f"<u{width}").tobytes())
        self.frames.append((self.at, len(part), zlib.crc32(part), self.docs, width))
        self.at += len(part) + 1
        self.open, self.held, self.docs = [], 0, 0
        return part

    def finish(self) -> Iterator[bytes]:
        if self.docs:
            yield self._close()
        if self.frames:
            keys = np.array([k or 0 for k in self.keys], "<i8")
            index = self.press.compress(np.array(self.frames, _FRAME).tobytes() + keys.tobytes() + np.array(self.counts, "<u8").tobytes() + np.array([k is not None for k in self.keys], "u1").tobytes())
            yield index + _FOOTER.pack(self.at, len(index), zlib.crc32(index), len(self.frames), len(self.keys), sum(self.counts), MAGIC)


class Reader:
    """One file's documents, by position; frames are decompressed when they are asked for."""

    def __init__(self, content: bytes | memoryview):
        import zstandard

        self.content, self.open = memoryview(content), zstandard.ZstdDecompressor()
        at, size, crc, frames, docs, self.ids, magic = _FOOTER.unpack(self.content[-_FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = self.open.decompress(self._checked(at, size, crc))
        self.frames = np.frombuffer(index, _FRAME, frames)
        index = index[self.frames.nbytes :]
        self.keys, self.counts, self.has_key = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u8", docs, 8 * docs).astype(np.int64), np.frombuffer(index, "u1", docs, 16 * docs)
        self.first = np.concatenate(([0], np.cumsum(self.frames["docs"], dtype=np.int64)))

    def _checked(self, at: int, size: int, crc: int) -> memoryview:
        part = self.content[at : at + size]
        if zlib.crc32(part) != crc:
            raise ValueError(f"the frame at {at} is damaged")
        return part

    def frame(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of the documents in a frame."""
        f = self.frames[k]
        ids = np.frombuffer(self.open.decompress(self._checked(int(f["offset"]), int(f["size"]), int(f["crc"]))), f"<u{f['width']}").astype("<u4")
        at = 0
        for doc in range(self.first[k], self.first[k + 1]):
            yield doc, ids[at : at + self.counts[doc]]
            at += self.counts[doc]

    def read(self, keys: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the documents with these ids; other frames stay compressed."""
        wanted = np.nonzero(np.isin(self.keys, list(keys)) & (self.has_key > 0))[0]
        for k in np.unique(np.searchsorted(self.first, wanted, side="right") - 1):
            for doc, ids in self.frame(int(k)):
                if doc in wanted:
                    yield int(self.keys[doc]), ids


def write_token_files(docs: DataFrame, path: str, vocabulary_name: str = VOCABULARY, end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_chars: int = FILE_CHARS) -> None:
    """Encodes docs (doc_id, text) and writes them to path, a file for each range of doc_id, in ascending order."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, writer = encoder(vocabulary(vocabulary_name), spaced=False), Writer(frame_ids)
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                for key, ids in zip(batch.column("doc_id").to_pylist(), code.encode(batch.column("text"))):
                    for part in writer.add(key, ids + end):
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])
        for part in writer.finish():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "tie", "number"]
    # the last two part rows that share a doc_id, even those of one text
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"tie": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(chars // file_chars + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, "part binary").select(F.col("part").cast("string").alias("value")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files at path; `file` is the number of its part, which ascends with doc_id."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    return found.select(F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long").alias("file"), "content")


def read_token_files(spark: SparkSession, path: str, keys: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (u32 bytes) of all documents at path, or of those in keys."""
    bounded_batches(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([Reader(content.as_buffer()).ids], pa.int64())], names=["file", "ids"])

    begins, at = {}, 0
    for r in sorted(_files(spark, path).mapInArrow(sizes, "file long, ids long").collect()):
        begins[r.file] = at
        at += r.ids
    shared = spark.sparkContext.broadcast((begins, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, wanted = shared.value
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                reader = Reader(content.as_buffer())
                before = begins[file] + np.concatenate(([0], np.cumsum(reader.counts)))
                picked = np.nonzero(np.isin(reader.keys, wanted) & (reader.has_key > 0))[0] if wanted is not None else np.arange(len(reader.keys))
                for k in np.unique(np.searchsorted(reader.first, picked, side="right") - 1):
                    rows = [(doc, ids) for doc, ids in reader.frame(int(k)) if wanted is None or doc in picked]
                    at = [d for d, _ in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.keys[at], mask=reader.has_key[at] == 0), pa.array(before[at]), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([x.tobytes() for _, x in rows], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return _files(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
