"""Token ids in files of fixed-width bits.

A table of segments: each row holds up to about a million ids of consecutive documents, every id in
the fewest bits that hold the vocabulary. Blocks of BLOCK ids start at byte offsets kept beside
them, so that any range of ids is read from its blocks alone and unpacked by numpy at once.

Layout of a segment, little-endian: 8 bytes mark, u4 bits, u4 ids a block, u8 ids, u8 documents;
then for the documents i8 id and u1 whether it is NULL, u8 starts (one more than documents); then u8
block offsets (one more than blocks), counted from the first packed byte; then the packed ids.

Defined cases: a NULL text is an empty one and gets the end id alone. NULL ids come first; rows with
equal ids stand in the order of a hash of their text. Extra columns aren't read. An empty table
gives no segment. Texts are encoded whole; one longer than a segment makes a segment of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import encoder

MARK = b"TSRBITS1"
BLOCK = 4096
_HEAD = struct.Struct("<8sIIQQ")

SEGMENTS = "file long, segment int, n_docs int, n_ids long, data binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A segment of documents with these ids and lengths."""
    packed = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    return b"".join(
        [
            _HEAD.pack(MARK, bits, BLOCK, len(ids), len(doc_ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(),
            np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype("<u8").tobytes(),
            *packed,
        ]
    )


@dataclass
class Segment:
    """A segment's tables; ids(a, b) reads only the blocks that hold ids a to b - 1."""

    data: bytes

    def __post_init__(self):
        mark, self.bits, self.block, self.n_ids, self.n_docs = _HEAD.unpack_from(self.data)
        if mark != MARK:
            raise ValueError("not a segment of packed ids")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.is_null = np.frombuffer(self.data, "u1", self.n_docs, at := at + 8 * self.n_docs)
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at := at + self.n_docs).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at := at + 8 * (self.n_docs + 1)).astype(np.int64)
        self.first = at + 8 * (n_blocks + 1)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else b
        if a >= b:
            return np.zeros(0, "<u4")
        lo, hi = a // self.block, -(-b // self.block)
        part = memoryview(self.data)[self.first + self.offsets[lo] : self.first + self.offsets[hi]]
        n = min(hi * self.block, self.n_ids) - lo * self.block
        return unpack(part, n, self.bits)[a - lo * self.block : b - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def packing(path: str, end_id: int, most_ids: int = 1_000_000, most_docs: int = 10_000):
    """Arrow function: (file, doc_id, text) rows in order to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        bits = max(1, (e.size - 1).bit_length())
        docs, lengths, parts, n, file, k = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            data = write_segment(docs, lengths, np.concatenate(parts), bits)
            return pa.RecordBatch.from_pydict({"file": [file], "segment": pa.array([k], pa.int32()), "n_docs": pa.array([len(docs)], pa.int32()), "n_ids": [n], "data": pa.array([data], pa.binary())})

        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for file, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), e.each(texts, end_id), strict=True):
                docs.append(d)
                parts.append(ids)
                lengths.append(len(ids))
                n += len(ids)
                if n >= most_ids or len(docs) >= most_docs:
                    yield segment()
                    docs, lengths, parts, n, k = [], [], [], 0, k + 1
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every text, add end_id, and write segments in ascending id order (files by range, segments within)."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
    ordered = rows.orderBy("d", F.xxhash64("t")).select(F.spark_partition_id().cast("long").alias("file"), "d", "t")
    ordered.mapInArrow(packing(tokenizer, end_id), SEGMENTS).write.parquet(path)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (file, segment, data) rows to one row a document, with its place in the segment."""
    for b in batches:
        for file, k, data in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            s = Segment(data)
            every, n = s.ids(), s.n_docs
            crc = [zlib.crc32(every[a:z]) for a, z in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * n, pa.int64()),
                    pa.array([k] * n, pa.int32()),
                    pa.array(s.doc_ids, mask=s.is_null.astype(bool)),
                    pa.array(s.starts[:-1]),
                    pa.array(np.diff(s.starts)),
                    pa.array(crc, pa.int64()),
                ],
                names=["file", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, segment, base: the ids of all segments before each, from two sums (over files, and within each)."""
    segments = spark.read.parquet(path).select("file", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    files = files.select("file", before(Window.orderBy("file")).alias("of_file"))  # one row a file
    inside = segments.select("file", "segment", before(Window.partitionBy("file").orderBy("segment")).alias("in_file"))
    return inside.join(files, "file").select("file", "segment", (F.col("of_file") + F.col("in_file")).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32, from the files."""
    rows = spark.read.parquet(path).select("file", "segment", "data").mapInArrow(digests, "file long, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(spark, path), ["file", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
