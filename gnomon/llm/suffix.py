"""Suffix-array de-duplication of byte strings.

Texts are cut into phrases at content-defined anchors (the smallest 16-byte gram of
some full window), so equal passages hold equal phrases. Each chunk of texts gets a
suffix array over its phrases, built by linear grouping; suffixes that share the
phrases of a full window lie side by side in it, and each such group asks once,
across all chunks, whether it occurs anywhere else. What phrases leave open, windows
at the edges of repeats, is settled by an exact check: their halves, then the cores
that neighbouring windows share, then the windows themselves, each only where the
step before found a repeat.

A chunk asks once for each distinct string it holds, however often it occurs there,
and gets bits back, so no group of copies is gathered in one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import U64, discard, documents, materialise, mix, packed, prefix, release, sorted_by, spans, table
from gnomon.llm.gsaca import suffix_array
from gnomon.llm.substring import _CHUNK_SCHEMA, cover, pack_chunks

CHUNK = 1_000_000  # bytes of text in a chunk
ENTRIES = 1_000_000  # aimed-at entries of one bucket of hashes
GRAM = 16
STEP = 24  # windows that share one core
_NO_ID = -(1 << 63)  # stands for a null doc_id while numbers are packed
_ASK = "bucket int, chunk_id long, h binary, x binary, many binary, need binary"
_REPLY = "bucket int, chunk_id long, n int, again binary, needed binary"
_KIND = 24  # a bucket's number has so many bits below its kind
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0).astype(np.int32)


class Chunk:
    """A chunk's bytes, its windows' anchors and what is known of them so far."""

    def __init__(self, row: dict, size: int, state: bytes | None = None):
        self.id, self.size = row["chunk_id"], size
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.blob = zstandard.ZstdDecompressor().decompress(row["text"]) if row["n"] else b""
        self.data = np.frombuffer(self.blob, np.uint8)
        self.offsets = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
        self.docs = np.flatnonzero(np.diff(self.offsets) >= size)  # texts that hold windows
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, self.offsets[self.docs], 1)
        np.add.at(edge, self.offsets[self.docs + 1] - size + 1, -1)
        self.at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))  # starts of windows
        self.again = np.zeros(len(self.at), bool)  # windows known to occur elsewhere
        if not len(self.at):
            return
        self.sums = prefix(self.data.astype(U64) + U64(1))
        if state is None:
            anchor = self._anchors()
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            self.marks, self.width = anchor[first], np.diff(np.append(first, len(anchor)))
            self.anchor = anchor
        else:
            had = pickle.loads(zstandard.ZstdDecompressor().decompress(state))
            self.marks, self.width = np.cumsum(had["marks"], dtype=np.int64), had["width"]
            self.anchor = np.repeat(self.marks, self.width)
            self.classes = had["classes"]
            for name in ("again", "live"):
                if name in had:
                    setattr(self, name, np.unpackbits(np.frombuffer(had[name], np.uint8), count=len(self.at)).astype(bool))

    def state(self, level: int) -> bytes:
        """What the next level needs to go on: anchors, the phrases' classes until they are answered, windows settled and open."""
        out: dict = {"marks": _gaps(self.marks), "width": self.width.astype(np.int32), "classes": self.classes if level == 0 else None}
        if level:
            out |= {"again": packed(np.packbits(self.again)), "live": packed(np.packbits(self.live))}
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))

    def _anchors(self) -> np.ndarray:
        """Each window's smallest gram, the leftmost of equals."""
        n = len(self.data)
        i = np.arange(n - GRAM + 1)
        low = mix(spans(self.sums, i, i + GRAM))
        low >>= U64(32)
        low <<= U64(32)
        low |= i.astype(U64)
        reach, width = self.size - GRAM + 1, 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        return (low[self.at] & U64((1 << 32) - 1)).astype(np.int64)

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mix(mix(spans(self.sums, start, end) + (end - start).astype(U64)) + U64(salt))

    def cuts(self) -> np.ndarray:
        """Where phrases start: at each anchor and at each text's start."""
        return np.union1d(self.marks, self.offsets[self.docs])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all phrases with 0 behind each text, place of each phrase in it, phrases of each phrase's run, two hashes of the run).

        A phrase's run are the phrases from it on that take in every window starting in it, or as many
        as its text still has.
        """
        start = self.cuts()
        owner = np.searchsorted(self.offsets, start, "right") - 1
        last = np.append(owner[1:] != owner[:-1], True)
        end = np.append(start[1:], len(self.data))
        end[last] = self.offsets[owner[last] + 1]
        doc_last = np.flatnonzero(last)
        own_last = doc_last[np.searchsorted(doc_last, np.arange(len(start)))]
        stop = np.minimum(np.searchsorted(end, end - 1 + self.size), own_last)
        phrase, size = self.hash(start, end, 2), stop + 1 - np.arange(len(start))
        h = mix(spans(prefix(phrase), np.arange(len(start)), stop + 1) + size.astype(U64))
        other = mix(spans(prefix(mix(self.data.astype(U64) + U64(77))), start, end))
        x = mix(spans(prefix(other), np.arange(len(start)), stop + 1)) >> U64(32)
        place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(last)[:-1]])
        text = np.zeros(len(start) + int(last.sum()), np.int64)
        text[place] = np.unique(phrase, return_inverse=True)[1] + 1
        return text, place, size, h, x

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class of each phrase, two hashes of each class, whether it has several phrases), classes in order of hash.

        Suffixes that start with the same run of phrases are neighbours in the suffix array: a class is a stretch
        of it, and begins where the prefix that a suffix shares with its neighbour, symbol by symbol, is shorter than
        their runs. What repeats inside a chunk is known from this alone; hashes name classes to other chunks.
        """
        text, place, size, h, x = self.runs()
        back = np.full(len(text), -1)
        back[place] = np.arange(len(place))
        order = back[suffix_array(text)]
        order = order[order >= 0]
        a, b = order[:-1], order[1:]
        alike = np.flatnonzero(size[a] == size[b])
        for k in range(int(size.max(initial=0))):
            i, j = a[alike], b[alike]
            alike = alike[(size[i] <= k) | (text[np.minimum(place[i] + k, len(text) - 1)] == text[np.minimum(place[j] + k, len(text) - 1)])]
            if not len(alike):
                break
        new = np.ones(len(order), bool)
        new[alike + 1] = False
        found, more = h[order[new]], x[order[new]]
        rank = np.empty(len(found), np.int32)
        by = np.lexsort((more, found))
        rank[by] = np.arange(len(found))
        classes = np.empty(len(order), np.int32)
        classes[order] = rank[np.cumsum(new) - 1]
        return classes, found[by], more[by], np.bincount(classes) > 1

    def questions(self, level: int) -> list[tuple[np.ndarray, ...]]:
        """[(window or anchor places, start, end, salt)] of the strings a level asks for."""
        if level == 0:
            a, half = self.marks, self.size // 2 - GRAM // 2
            doc = np.searchsorted(self.offsets, a, "right") - 1
            left, right = a - half, a + self.size - half
            ok_l, ok_r = left >= self.offsets[doc], right <= self.offsets[doc + 1]
            return [(a[ok_l], left[ok_l], a[ok_l] + GRAM, 3), (a[ok_r], a[ok_r], right[ok_r], 4)]
        open_ = np.flatnonzero(self.live)
        if level == 1:
            start = self.anchor[open_]
            start -= STEP * ((start - self.at[open_]) // STEP)
            return [(open_, start, start - STEP + 1 + self.size, 5)]
        return [(open_, self.at[open_], self.at[open_] + self.size, 6)]


class Book:
    """The distinct strings of one question of a chunk, and how its places refer to them."""

    def __init__(self, c: Chunk, level: int, kind: int):
        self.x = np.empty(0, U64)
        if not len(c.at):
            self.h, self.many = np.empty(0, U64), np.empty(0, bool)
            self.group = self.place = np.empty(0, np.int64)
            return
        if kind == 0:  # runs of phrases
            if not hasattr(c, "classes"):
                c.classes, self.h, self.x, self.many = c.repeats()
            self.group, self.place = c.classes, np.arange(len(c.classes))
            return
        place, start, end, salt = c.questions(level)[kind - 1]
        h = c.hash(start, end, salt)
        x = mix(spans(prefix(mix(c.data.astype(U64) + U64(77))), start, end)) >> U64(32) if level == 2 and len(h) else None  # 96 bits settle it
        order, new = sorted_by(h, x)
        self.h, self.x = h[order[new]], x[order[new]] if x is not None else self.x
        self.place, self.group = place[order], np.cumsum(new) - 1
        # the same core of several windows of one place is one occurrence
        spot = start[order]
        low, high = (f.reduceat(spot, np.flatnonzero(new)) if len(spot) else spot for f in (np.minimum, np.maximum))
        self.many = low != high


def _kinds(level: int) -> tuple[int, ...]:
    return (0, 1, 2) if level == 0 else (1,)


def _bits(replies: list[dict], name: str) -> np.ndarray:
    """The answers to a book's strings, in order: buckets are ranges of hashes."""
    got = [np.unpackbits(np.frombuffer(x[name], np.uint8), count=x["n"]) for x in sorted(replies, key=lambda x: x["bucket"])]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


def _learn(c: Chunk, replies: list[dict], level: int) -> None:
    """Take in a level's answers."""
    if not len(c.at):
        return
    for kind in _kinds(level):
        book = Book(c, level, kind)
        mine = [x for x in replies if x["bucket"] >> _KIND == kind]
        again = _bits(mine, "again")
        if kind == 0:
            known = again[book.group]
            c.again |= known[np.searchsorted(c.cuts(), c.at, "right") - 1]
        elif level == 0:
            if kind == 1:
                c.live = np.zeros(len(c.at), bool)
            found = book.place[again[book.group]]
            flag = np.zeros(len(c.data) + 1, bool)
            flag[found] = True
            left = c.anchor - c.at >= c.size // 2 - GRAM // 2
            c.live |= (left if kind == 1 else ~left) & flag[c.anchor]
        elif level == 1:
            needed = _bits(mine, "needed")
            own = np.zeros(len(again), bool)
            np.logical_or.at(own, book.group, ~c.again[book.place])
            live = np.zeros(len(c.at), bool)
            live[book.place] = (again & (needed | own))[book.group]
            c.live = live
        else:
            c.again[book.place] |= again[book.group]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], level: int, size: int) -> Iterator[Chunk]:
    """Chunks that have taken in the answers of all levels below ``level``."""
    release()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            replies = (row["replies"] or []) if level else []
            c = Chunk(row, size, next((x["again"] for x in replies if x["bucket"] < 0), None))
            if level:
                _learn(c, [x for x in replies if x["bucket"] >= 0], level - 1)
            yield c


def _asks(level: int, bits: int, size: int):
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, level, size):
            if not len(c.at):
                continue
            rows = []
            for kind in _kinds(level):
                book = Book(c, level, kind)
                if not len(book.h):
                    continue
                need = np.zeros(len(book.h), bool)
                if level == 1:
                    np.logical_or.at(need, book.group, ~c.again[book.place])
                bucket = _bucket(book.h, bits)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows += [(int(bucket[s]) + (kind << _KIND), c.id, packed(book.h[s:e]), packed(book.x[s:e].astype(np.uint32)), packed(np.packbits(book.many[s:e])), packed(np.packbits(need[s:e]))) for s, e in zip(cut, [*cut[1:], len(book.h)], strict=True)]
            rows.append((-1 - (c.id * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - _KIND), c.id, c.state(level), b"", b"", b""))  # comes back beside the answers
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ASK.split(", ")])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """All entries of one bucket -> for each: does it occur elsewhere? does an open window elsewhere need it?"""
    rows = group.to_pylist()
    if rows[0]["bucket"] < 0:  # chunks' states
        return group.select(["bucket", "chunk_id"]).append_column("n", pa.array([0] * len(rows), pa.int32())).append_column("again", group.column("h")).append_column("needed", group.column("need"))
    h = np.concatenate([np.frombuffer(r["h"], U64) for r in rows])
    x = np.concatenate([np.frombuffer(r["x"], np.uint32) for r in rows])
    size = [len(r["h"]) // 8 for r in rows]
    many, need = (np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=n) for r, n in zip(rows, size, strict=True)]).astype(bool) for k in ("many", "need"))
    order, new = sorted_by(h, x)
    at0, which = np.flatnonzero(new), np.cumsum(new) - 1
    source = np.repeat(np.arange(len(rows)), size)[order]  # a chunk has one row here, and knows itself what it has several times
    twice = (np.minimum.reduceat(source, at0) != np.maximum.reduceat(source, at0)) | np.logical_or.reduceat(many[order], at0)
    wanted = np.logical_or.reduceat(need[order], at0)
    again, needed = np.empty(len(order), bool), np.empty(len(order), bool)
    again[order], needed[order] = twice[which], wanted[which]
    cut = np.concatenate([[0], np.cumsum(size)])
    both = [[packed(np.packbits(v[s:e])) for s, e in zip(cut, cut[1:], strict=False)] for v in (again, needed)]
    return pa.table({"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "chunk_id": pa.array([r["chunk_id"] for r in rows], pa.int64()), "n": pa.array(size, pa.int32()), "again": pa.array(both[0], pa.binary()), "needed": pa.array(both[1], pa.binary())})


def _texts(level: int, size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, level, size):
            gone = cover(c.at[c.again], size, len(c.data))
            rows = []
            for k in range(len(c.ids)):
                a, b = int(c.offsets[k]), int(c.offsets[k + 1])
                mine = gone[a:b]
                removed = int(mine.sum())
                kept = c.blob[a:b] if not removed else c.data[a:b][~mine].tobytes()
                runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0
                rows.append((None if c.ids[k] == _NO_ID else int(c.ids[k]), b - a, removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            for s in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[s : s + 2000], strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def suffix_dedup(docs: DataFrame, size: int = 200, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Remove every byte covered by a string of ``size`` bytes that also starts anywhere else.

    Texts are UTF-8; strings never cross texts, may overlap and also count within one text, and are
    judged on the input. Output: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes) and, with ``with_text``, kept (these bytes).

    Null and empty texts have no bytes. Texts shorter than ``size`` are kept whole. Repeated and null
    doc_ids are texts of their own; an empty table gives no rows.
    """
    if size < 2 * GRAM + STEP:
        raise ValueError(f"size must be at least {2 * GRAM + STEP}")
    docs = documents(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))))
    chunks = materialise(docs.mapInArrow(lambda it: pack_chunks(it, chunk), _CHUNK_SCHEMA), "none")
    total = 3 * (chunks.agg(F.sum(F.expr("octet_length(text)"))).first()[0] or 0)
    # an anchor for half a window; a core for STEP windows; windows of a tenth of the text
    expected = [2 * total / size, total / STEP / 4, total / 10]
    bits = [max(0, min(_KIND, int(np.ceil(np.log2(max(1, e / ENTRIES)))))) for e in expected]
    asking = chunks
    for level in range(3):
        got = materialise(asking.mapInArrow(_asks(level, bits[level], size), _ASK).groupBy("bucket").applyInArrow(_answer, _REPLY))
        own = got.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "n", "again", "needed")).alias("replies"))
        if level:
            discard(before)
        before, asking = got, chunks.join(own, "chunk_id", "left")
    out = asking.mapInArrow(_texts(3, size, with_text), _OUT)
    return out if with_text else out.drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
