"""Token ids as fixed-width bit-packed files with block offsets.

A file is: magic, id width in bits, number of ids, ids in a block, number of
documents, block offsets (8 bytes each, from the start of the blocks), each
document's end (8 bytes, in ids), then the blocks. Ids lie from the lowest bit up;
a block starts at a byte, so any range is read by unpacking the blocks it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import documents, materialise, packed, table
from gnomon.llm.tokens import encoder, text_runs

MAGIC = b"GNOMBIT1"
_HEAD = struct.Struct("<8sIIQQ")
BLOCK = 4096  # ids
FILE_IDS = 1 << 20  # ids of a file, or of one longer document


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    if width in (8, 16, 32):
        return packed(ids.astype(f"<u{width // 8}"))
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return packed(np.packbits(bits.ravel(), bitorder="little"))


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return data[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * width
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= pad[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_file(ids: np.ndarray, ends: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """Ids of consecutive documents and where each ends -> one file."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id needs more bits than the vocabulary has")
    blocks = [pack_bits(ids[s : s + block], width) for s in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([_HEAD.pack(MAGIC, width, block, len(ids), len(ends)), packed(offsets), packed(np.asarray(ends, "<u8")), *blocks])


class File:
    """Random access to an encoded file."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        raw = np.frombuffer(data, np.uint8)
        blocks = -(-self.n // self.block)
        at = _HEAD.size
        self.offsets = raw[at : at + 8 * (blocks + 1)].copy().view("<u8").astype(np.int64)
        at += 8 * (blocks + 1)
        self.ends = raw[at : at + 8 * docs].copy().view("<u8").astype(np.int64)
        self.raw = raw[at + 8 * docs :]

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids [a, b), unpacking no other blocks than theirs."""
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        got = [unpack_bits(self.raw[self.offsets[k] : self.offsets[k + 1]].copy(), min(self.block, self.n - k * self.block), self.width) for k in range(first, last + 1)]
        return np.concatenate(got)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts in ascending doc_id order and store them in files.

    The files are rows (part, seq, before, n_ids, doc_ids, data) of a table in the shared folder, so
    any store the cluster writes to will do; ``data`` is the file and ``before`` the number of ids in
    the files of its part that precede it. Null doc_ids come first; repeated
    doc_ids lie side by side. A null or empty text has the end id alone.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        width = width_of(enc.tokenizer.get_vocab_size(with_added_tokens=True))
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, before
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes))
            data = encode_file(ids, ends, width)
            row = [[part], [seq], [before], [len(ids)], [list(keys)], [data]]
            seq += 1
            before += len(ids)
            for x in (held, sizes, keys):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()], strict=True)], names=["part", "seq", "before", "n_ids", "doc_ids", "data"])

        n = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_runs(texts):
                flat, count = enc.ids(texts[a:b])
                if n and n + len(flat) + b - a > file_ids:
                    yield flush()
                    n = 0
                held.append(np.insert(flat, np.cumsum(count), np.uint32(end_id)))
                sizes.append(count + 1)
                keys.extend(ids[a:b])
                n += len(held[-1])
        if n:
            yield flush()

    source = documents(docs)
    ordered = source.withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialise(ordered.mapInArrow(run, "part long, seq long, before long, n_ids long, doc_ids array<long>, data binary"), "none")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read from the files.

    Only a number for each written partition is gathered and broadcast, to place it after those before
    it; that is bounded by the partitions of the write, not by rows. Files are not shuffled.
    """
    spark = files.sparkSession
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before, strict=False)] or [(0, 0)], "part long, base long")
    placed = files.join(F.broadcast(base), "part").select("doc_ids", "data", (F.col("base") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = File(row["data"])
                ids = f.ids().astype("<u4")
                start = np.concatenate([[0], f.ends[:-1]])
                crc = [zlib.crc32(packed(ids[a:b])) for a, b in zip(start, f.ends, strict=True)]
                for s in range(0, len(crc), 5000):
                    e = s + 5000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][s:e], pa.int64()), pa.array(start[s:e] + row["base"]), pa.array((f.ends - start)[s:e]), pa.array(crc[s:e], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents")))
