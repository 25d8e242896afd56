"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's full windows
leave at once; its rest goes to the open window it fits best. When it fits none,
the fullest window is topped up with the rest's head and emitted. The windows a
partition leaves open are merged in rounds of a bounded number of partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import documents, materialise, packed, release, table
from gnomon.llm.tokens import encoder, text_runs

OPEN = 16  # open windows of a partition
FAN = 64  # partitions' leftovers that one task merges
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 8 + [pa.binary()]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) and yields rows of finished sequences."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.windows, self.next = size, windows, base
        self.open: list[list] = []  # [filled, pieces]
        self.rows: list[tuple] = []

    def close(self, pieces: list, part: int | None = None) -> None:
        """Emit pieces as one sequence, or as a leftover of ``part``."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(packed(ids)), total, self.next, offset, -1 if part is None else part, None if part is None else packed(ids)))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.close([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        if start < total:
            self.place(doc, start, ids[start:], total)

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        fits = [w for w in self.open if w[0] + len(ids) <= self.size]
        if fits:
            w = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.windows:
            w = [0, []]
            self.open.append(w)
        else:  # none fits: the fullest goes, topped up
            w = max(self.open, key=lambda w: w[0])
            cut = self.size - w[0]
            self.open.remove(w)
            self.close([*w[1], (doc, start, ids[:cut], total)] if cut else w[1])
            self.place(doc, start + cut, ids[cut:], total)
            return
        w[0] += len(ids)
        w[1].append((doc, start, ids, total))
        if w[0] == self.size:
            self.open.remove(w)
            self.close(w[1])

    def stream(self, pieces: list) -> list:
        """Fill sequences one after the other, cutting pieces; what is left over of the last one."""
        held: list = []
        filled = 0
        for doc, start, ids, total in pieces:
            while len(ids):
                cut = min(len(ids), self.size - filled)
                held.append((doc, start, ids[:cut], total))
                filled, start, ids = filled + cut, start + cut, ids[cut:]
                if filled == self.size:
                    self.close(held)
                    held, filled = [], 0
        return held

    def powers(self, pieces: list) -> None:
        """Emit the very last pieces as sequences of powers of two: they need no padding."""
        left = sum(len(p[2]) for p in pieces)
        bits = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
        size = self.size
        for b in bits:
            self.size = b
            head, got = [], 0
            while got < b:
                doc, start, ids, total = pieces[0]
                cut = min(len(ids), b - got)
                head.append((doc, start, ids[:cut], total))
                got += cut
                pieces = [(doc, start + cut, ids[cut:], total), *pieces[1:]] if cut < len(ids) else pieces[1:]
            self.close(head)
        self.size = size

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, _TYPES, strict=True)], names=_NAMES)


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, windows: int = OPEN, fan: int = FAN) -> DataFrame:
    """Tokenize whole texts and pack the ids into sequences of at most ``size`` ids.

    A document is its text's ids and ``end_id``; a null or empty text has that id alone. All
    sequences are full but the last few, whose lengths are powers of two: nothing is padded.

    Output: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Rows that repeat a doc_id are packed each; a null doc_id is kept. An empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(path)
        part = TaskContext.get().partitionId()
        p, enc = Packer(size, windows, part << 36), encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_runs(texts):
                flat, count = enc.ids(texts[a:b])
                edge = np.concatenate([[0], np.cumsum(count)])
                for k in range(b - a):
                    p.add(ids[a + k], np.append(flat[edge[k] : edge[k + 1]], np.uint32(end_id)))
                yield p.take()
        p.next = (part << 36) + (1 << 35)
        for _, pieces in p.open:
            p.close(pieces, part)
        yield p.take()

    source = documents(docs)
    done = materialise(source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SCHEMA))
    left, out, round_no = done.filter("part >= 0"), done.filter("part < 0"), 0
    while True:
        last = (left.agg(F.max("part")).first()[0] or 0) < fan
        left = materialise(_merged(left, size, fan, round_no, last))
        out = out.unionByName(left.filter("part < 0"))
        if last:
            return out.select(*_NAMES[:7])
        left, round_no = left.filter("part >= 0"), round_no + 1


def _merged(left: DataFrame, size: int, fan: int, round_no: int, last: bool) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["sequence_id"], r["offset"]))
        to = rows[0]["part"] // fan
        p = Packer(size, 1, (1 << 62) + (round_no << 56) + (to << 24))
        rest = p.stream([(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"]) for r in rows])
        if last:
            p.powers(rest)
        else:
            p.close(rest, to)
        return pa.Table.from_batches([p.take()])

    return left.groupBy(F.floor(F.col("part") / fan).alias("to")).applyInArrow(run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
