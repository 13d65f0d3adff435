"""Token-id files: concatenated ids with Elias-Fano encoded document borders.

A file holds the documents of one doc_id range. Layout, all integers little-endian:

    ids          n_ids unsigned 16- or 32-bit integers (16 if the vocabulary allows), documents one after another
    borders      Elias-Fano sequence of n_docs + 1 offsets into ids
    doc ids      Elias-Fano sequence of the doc_ids minus their smallest (null ids come first and are counted)
    footer       FOOTER struct: magic, id width, counts, smallest doc_id, sizes of the sections

An Elias-Fano sequence of n values below U keeps floor(log2(U / n)) low bits of each value packed, and the high parts in
unary in a bit vector of at most 2n + 1 bits, with the position of every SAMPLE-th set bit: ``select`` finds one offset
without decoding the others. That is about 2 + log2(U / n) bits a value instead of 64.

Documents are ordered by a range shuffle on (doc_id, text hash); each range streams its ids to one file, written under a
temporary name and moved when complete, so a repeated task replaces its own file and nothing else. Files lie in a shared
folder and are read back by path through the file system of its URI.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated rows are kept one by one; an
empty table writes no file and gives no rows; other columns take no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raytable.runtime import ensure_checkpoint_dir

from .common import id_text, prepare
from .tokens import encoder

END_ID = 2
SAMPLE = 64
MAGIC = b"EFTOK1\0\0"
FOOTER = struct.Struct("<8sQQQQqQQ")  # magic, id width, ids, documents, null doc_ids, smallest doc_id, bytes of borders, of doc ids
_HEAD = struct.Struct("<QQQ")  # values, low bits, bytes of the high bit vector


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return cls(n, low_bits, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype("<u4" if not n or ones[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize == 8
        return _HEAD.pack(self.n << 1 | wide, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, low_bits, high = _HEAD.unpack_from(data)
        wide, n = n & 1, n >> 1
        at = _HEAD.size
        low_bytes = -(-n * low_bits // 8)
        low = np.frombuffer(data, np.uint8, low_bytes, at)
        vector = np.frombuffer(data, np.uint8, high, at + low_bytes)
        samples = np.frombuffer(data, "<u8" if wide else "<u4", -(-n // SAMPLE), at + low_bytes + high)
        return cls(n, low_bits, low, vector, samples)

    def _low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value i alone: from the nearest sampled set bit onwards."""
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        if rest:
            byte = at >> 3
            seen = int((self.high[byte] >> (at & 7)).bit_count())  # set bits from the sample to the end of its byte
            while seen <= rest:
                byte += 1
                seen += int(self.high[byte]).bit_count()
            inside = np.flatnonzero(np.unpackbits(self.high[byte: byte + 1], bitorder="little"))
            at = 8 * byte + int(inside[len(inside) - (seen - rest)])
        return ((at - i) << self.low_bits) + int(self._low_part(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) + np.concatenate([self._low_part(i[k: k + 65536]) for k in range(0, max(self.n, 1), 65536)])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Streams ids to a file; borders and doc_ids stay in memory, 16 bytes a document."""

    def __init__(self, uri: str, width: int):
        self.files, self.path = _open(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.width = self.files.open_output_stream(self.temporary), width
        self.borders: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.total, self.doc_ids, self.nulls = 0, [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, borders: np.ndarray) -> None:
        if self.width == 2 and len(ids) and int(ids.max()) >= 1 << 16:
            raise ValueError("an id does not fit 16 bits")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.borders.append(self.total + borders[1:])
        self.total += len(ids)
        self.nulls += sum(d is None for d in doc_ids)
        self.doc_ids += [d for d in doc_ids if d is not None]

    def close(self) -> None:
        base = self.doc_ids[0] if self.doc_ids else 0
        borders = EliasFano.encode(np.concatenate(self.borders)).to_bytes()
        doc_ids = EliasFano.encode(np.array([d - base for d in self.doc_ids], np.uint64)).to_bytes()
        self.out.write(borders + doc_ids)
        self.out.write(FOOTER.pack(MAGIC, self.width, self.total, self.nulls + len(self.doc_ids), self.nulls, base, len(borders), len(doc_ids)))
        self.out.close()
        self.files.move(self.temporary, self.path)


class Reader:
    """One file: borders and doc_ids decoded on demand, ids of a document by two selects and one ranged read."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        size = files.get_file_info(path).size
        self.file = files.open_input_file(path)
        magic, self.width, self.n_ids, self.n_docs, self.nulls, self.base, b, d = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.borders = EliasFano.from_bytes(self.file.read_at(b, size - FOOTER.size - d - b))
        self._doc_ids = EliasFano.from_bytes(self.file.read_at(d, size - FOOTER.size - d))

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self._doc_ids.values() + self.base).tolist()

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of documents first .. last - 1."""
        low, high = self.borders.select(first), self.borders.select(last)
        return np.frombuffer(self.file.read_at((high - low) * self.width, low * self.width), f"<u{self.width}")


MANIFEST = "file string, part int, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, tokenizer: str, folder: str, spaced: bool, width: int = 2) -> DataFrame:
    """Write every document; returns the manifest, one row per file in ascending doc_id order."""
    prepare(docs.sparkSession)
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = id_text(docs).repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/part-{part:06d}.tok"
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids, borders in encoder(tokenizer, spaced).ids(batch.column(1), END_ID):
                out = out or Writer(uri, width)
                out.add(doc_ids[row: row + len(borders) - 1], ids, borders)
        if out:
            out.close()
            n = out.nulls + len(out.doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([out.total], pa.int64())],
                                             ["file", "part", "n_docs", "n_ids"])

    return ordered.mapInArrow(run, MANIFEST).checkpoint(eager=True)


def read(spark: SparkSession, manifest: DataFrame, block: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(uri)
                borders, doc_ids = reader.borders.values(), reader.doc_ids()
                for a in range(0, reader.n_docs, block):
                    b = min(a + block, reader.n_docs)
                    crc = []
                    for i in range(a, b):
                        if i == a or i >= end:  # a bounded stretch of documents at a time
                            end = max(i + 1, min(b, int(np.searchsorted(borders, borders[i] + (4 << 20), "right")) - 1))
                            ids, low = reader.ids(i, end).astype("<u4"), int(borders[i])
                        crc.append(zlib.crc32(ids[int(borders[i]) - low: int(borders[i + 1]) - low]))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(borders[a:b] + before),
                                                      pa.array(np.diff(borders[a: b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file; the running total over files is the only step that sees all of them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return files.repartition("file").mapInArrow(run, READ)


def round_trip(docs: DataFrame, tokenizer: str, spaced: bool = False, width: int = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(spark, write(docs, tokenizer, folder, spaced, width))
