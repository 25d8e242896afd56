"""Substring de-duplication by level-wise doubling.

Windows of words that repeat at one length, alone, are extended to twice that
length, until no candidate survives. The first level has half the asked length and
looks only at content-defined anchors (each full window's smallest half-length
hash): two equal windows hold equal anchors, so a full window whose anchor does not
repeat cannot repeat. What is removed is settled at the asked length; from there on
only the words that repeated windows cover travel, as runs of word hashes.

Texts travel in chunks of a bounded size. At each level a chunk asks once for
each distinct window hash it holds, whatever the number of its documents, so a
window shared by a third of all rows costs one entry a chunk; the answer is two
bits an entry. No group of documents is ever gathered in one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import U64, discard, documents, materialise, mix, packed, prefix, release, slices, sorted_by, spans, table, utf8, word_hashes, words

CHUNK = 2_000_000  # bytes of text in a chunk
ENTRIES = 1_000_000  # aimed-at entries of one bucket of hashes

_CHUNK_SCHEMA = "chunk_id long, n long, ids binary, ends binary, nulls binary, text binary"
_CHUNK_TYPES = [pa.int64() if c.endswith("long") else pa.binary() for c in _CHUNK_SCHEMA.split(", ")]
_ASK_SCHEMA = "bucket int, chunk_id long, h1 binary, h2 binary, low binary, many binary"
_REPLY_SCHEMA = "bucket int, chunk_id long, n int, alive binary, earlier binary, n_alive long"
_DOC_SCHEMA = "chunk_id long, k int, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text_key long, state binary"
_DOC_KINDS = [pa.int64(), pa.int32()] + [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.binary()]


_NO_ID = -(1 << 63)  # stands for a null doc_id while numbers are packed


def pack_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> rows of about ``limit`` bytes of compressed text each."""
    squeeze, seq, part = zstandard.ZstdCompressor(level=3), 0, TaskContext.get().partitionId()
    ids: list[np.ndarray] = []
    size: list[np.ndarray] = []
    null: list[np.ndarray] = []
    text: list[bytes] = []

    def flush() -> pa.RecordBatch:
        nonlocal seq
        i, ends, nul = np.concatenate(ids), np.cumsum(np.concatenate(size)), np.concatenate(null)
        row = [(part << 32) + seq, len(i), packed(i), packed(ends), packed(nul), squeeze.compress(b"".join(text))]
        seq += 1
        for x in (ids, size, null, text):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_TYPES, strict=True)], names=[c.split()[0] for c in _CHUNK_SCHEMA.split(", ")])

    held = 0
    for batch in batches:
        data, offsets, nul = utf8(batch.column("text"))
        doc = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, limit // 4):
            got = int(offsets[b] - offsets[a])
            if ids and held + got > limit:
                yield flush()
                held = 0
            ids.append(doc[a:b].copy())
            size.append(np.diff(offsets[a : b + 1]))
            null.append(nul[a:b])
            text.append(data[offsets[a] : offsets[b]].tobytes())
            held += got
    if ids:
        yield flush()


class Chunk:
    """A chunk's words and their hashes."""

    def __init__(self, row: dict):
        self.id = row["chunk_id"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]) if row["n"] else b"", np.uint8)
        self.offsets = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
        self.start, self.end, self.first = words(self.data, self.offsets)
        self.counts = np.diff(self.first)
        self.h = word_hashes(self.data, self.start, self.end)
        self.runs = Runs(self.ids, np.arange(len(self.ids)), self.counts, self.h)

    def anchors(self, half: int, full: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of half windows that are some full window's smallest, the leftmost of equals; how many windows each serves)."""
        r = self.runs
        at = r.whole(full)
        h = np.zeros(len(r.last), U64)
        ok = r.whole(half)
        h[ok] = mix(spans(r.sums[0], ok, ok + half))
        low, where = h[at], at.copy()
        for k in range(1, full - half + 1):
            x = h[at + k]
            less = x < low
            low[less] = x[less]
            where[less] = at[less] + k
        first = np.flatnonzero(np.diff(where, prepend=-1))
        return where[first], np.diff(np.append(first, len(where)))


class Runs:
    """Runs of words, each of one document: the hashes of their windows."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, size: np.ndarray, h: np.ndarray):
        """``ids`` of documents; the run's document, by place in ``ids``; its number of words; the hash of each word."""
        self.ids = ids
        self.doc = np.repeat(doc, size)
        self.last = np.repeat(np.cumsum(size), size)  # of each word, where its run's words end
        self.sums = (prefix(h), prefix(mix(h + U64(1))))

    def whole(self, length: int) -> np.ndarray:
        """Starts of all windows of that many words inside one run."""
        i = np.arange(len(self.last))
        return i[i + length <= self.last]

    def distinct(self, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(order, group of each ordered position, h1, h2, smallest doc_id, seen in several documents?)"""
        h1, h2 = (mix(spans(s, at, at + length)) for s in self.sums)
        h2 >>= U64(32)  # 96 bits in all travel
        order, new = sorted_by(h1, h2)
        at0, group = np.flatnonzero(new), np.cumsum(new) - 1
        doc = self.ids[self.doc[at[order]]]
        low, high = (f.reduceat(doc, at0) if len(at0) else doc[:0] for f in (np.minimum, np.maximum))
        return order, group, h1[order[new]], h2[order[new]], low, low != high


def _squeezed(**values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values))


def _opened(state: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(state))


_ASK_KINDS = [pa.int32(), pa.int64()] + [pa.binary()] * 4


def _ask(chunk_id: int, found: tuple[np.ndarray, ...], bits: int, second: bool, state: bytes) -> pa.RecordBatch:
    """A chunk's distinct windows by bucket, and its state, which comes back beside the answers."""
    _, _, h1, h2, low, many = found
    bucket = (h1 >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h1), np.int32)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = [(int(bucket[s]), chunk_id, packed(h1[s:e]), packed(h2[s:e].astype(np.uint32)) if second else b"", packed(low[s:e]), packed(np.packbits(many[s:e]))) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(h1)][: len(cut)], strict=True)]
    rows.append((-1 - (chunk_id * 0x9E3779B97F4A7C15 % (1 << 64) >> 40), chunk_id, state, b"", b"", b""))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ASK_KINDS, strict=True)], names=[c.split()[0] for c in _ASK_SCHEMA.split(", ")])


def _asks(level: int, lengths: list[int], bits: int):
    """Ask at the anchors of half windows (level 0), then for the full windows whose anchor repeats (level 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                if level == 0:
                    marks, width = c.anchors(*lengths)
                    yield _ask(c.id, c.runs.distinct(marks, lengths[0]), bits, False, _squeezed(marks=np.diff(marks, prepend=0).astype(np.int32), width=width.astype(np.int32)))
                    continue
                state, replies = _parted(row["replies"])
                marks = np.cumsum(state["marks"], dtype=np.int64)
                order, group, *_ = c.runs.distinct(marks, lengths[0])
                alive = np.zeros(len(marks), bool)
                alive[order] = _bits(replies, "alive")[group]
                open_ = np.repeat(alive, state["width"])
                yield _ask(c.id, c.runs.distinct(c.runs.whole(lengths[1])[open_], lengths[1]), bits, True, _squeezed(open=np.packbits(open_)))

    return run


def _parted(replies: list[dict]) -> tuple[dict, list[dict]]:
    """(a chunk's state, its answers in order of bucket)"""
    state = next(x["alive"] for x in replies if x["bucket"] < 0)
    return _opened(state), sorted((x for x in replies if x["bucket"] >= 0), key=lambda x: x["bucket"])


def _bits(replies: list[dict], name: str) -> np.ndarray:
    got = [np.unpackbits(np.frombuffer(x[name], np.uint8), count=x["n"]) for x in replies]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


def _answer(group: pa.Table) -> pa.Table:
    """All entries of one bucket of hashes -> two bits for each: in several documents? in a smaller one?"""
    rows = group.to_pylist()
    if rows[0]["bucket"] < 0:  # chunks' states
        none = pa.array([0] * len(rows), pa.int32())
        return group.select(["bucket", "chunk_id"]).append_column("n", none).append_column("alive", group.column("h1")).append_column("earlier", group.column("low")).append_column("n_alive", none.cast(pa.int64()))
    h1 = np.concatenate([np.frombuffer(r["h1"], U64) for r in rows])
    h2 = np.concatenate([np.frombuffer(r["h2"], np.uint32) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.int64) for r in rows])
    size = [len(r["low"]) // 8 for r in rows]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n) for r, n in zip(rows, size, strict=True)]).astype(bool)
    order, new = sorted_by(h1, h2)
    at0, which = np.flatnonzero(new), np.cumsum(new) - 1
    smallest = np.minimum.reduceat(low[order], at0)
    several = np.logical_or.reduceat(many[order], at0) | (smallest != np.maximum.reduceat(low[order], at0))
    alive, earlier = np.empty(len(order), bool), np.empty(len(order), bool)
    alive[order] = several[which]
    earlier[order] = smallest[which] < low[order]
    cut = np.concatenate([[0], np.cumsum(size)])
    both = [[packed(np.packbits(v[s:e])) for s, e in zip(cut, cut[1:], strict=False)] for v in (alive, earlier)]
    return pa.table({
        "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "chunk_id": pa.array([r["chunk_id"] for r in rows], pa.int64()),
        "n": pa.array(size, pa.int32()),
        "alive": pa.array(both[0], pa.binary()),
        "earlier": pa.array(both[1], pa.binary()),
        "n_alive": pa.array([int(alive[s:e].sum()) for s, e in zip(cut, cut[1:], strict=False)], pa.int64()),
    })


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for some start s."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _grown(ids: np.ndarray, doc: np.ndarray, size: np.ndarray, h: np.ndarray, at: np.ndarray, length: int) -> dict:
    """Runs of words that windows ``at`` cover, as a state: what can hold a window of twice the length."""
    words_ = np.concatenate([[0], np.cumsum(size)])
    on = np.concatenate([[False], cover(at, length, len(h)), [False]])
    # neighbouring windows of two runs never join: a run's last word ends its stretch
    edge = np.zeros(len(h) + 1, bool)
    edge[words_] = True
    begin = on[1:-1] & (~on[:-2] | edge[:-1])
    stop = on[1:-1] & (~on[2:] | edge[1:])
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    owner = np.repeat(doc, size)[s] if len(s) else np.empty(0, np.int64)
    inside = on[1:-1]
    table_, code = np.unique(h[inside], return_inverse=True)
    moved = np.cumsum(inside) - 1
    return {"ids": ids, "doc": owner, "size": e - s, "table": table_, "code": code.astype(np.int32), "alive": np.diff(np.sort(moved[at]), prepend=0).astype(np.int32), "length": length}


def _texts(lengths: list[int], with_text: bool, grow: bool):
    """Take in the answers at full length: the documents' rows, and with ``grow`` the runs that go on growing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n = lengths[1]
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                state, replies = _parted(row["replies"])
                at = c.runs.whole(n)
                at = at[np.unpackbits(state["open"], count=len(at)).astype(bool)]
                order, group, _, _, low, _ = c.runs.distinct(at, n)
                at, earlier, alive = at[order], _bits(replies, "earlier")[group], _bits(replies, "alive")[group]
                hit = earlier | (c.ids[c.runs.doc[at]] > low[group])
                gone = cover(at[hit], n, len(c.start))
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), c.first[:-1]) * (c.counts > 0)
                null = np.frombuffer(row["nulls"], bool)
                sha, kept, key = [], [], []
                blob = c.data.tobytes()
                for k in range(len(c.ids)):
                    parts = blob[c.offsets[k] : c.offsets[k + 1]].split()
                    if removed[k]:
                        keep = ~gone[c.first[k] : c.first[k + 1]]
                        parts = [p for p, on in zip(parts, keep.tolist(), strict=True) if on]
                    text = b" ".join(parts)
                    sha.append(hashlib.sha256(text).hexdigest())
                    if not removed[k]:
                        text = blob[c.offsets[k] : c.offsets[k + 1]]
                    kept.append(text.decode("utf-8", "replace") if with_text and not null[k] else None)
                    key.append(_signed(xxhash.xxh64_intdigest(blob[c.offsets[k] : c.offsets[k + 1]], 42)) if with_text and not null[k] else 42)
                for s in range(0, len(c.ids), 2000):
                    e = min(s + 2000, len(c.ids))
                    yield _doc_rows([c.id] * (e - s), range(s, e), c.ids[s:e], c.counts[s:e].astype(np.int64), removed[s:e], sha[s:e], kept[s:e], key[s:e], [None] * (e - s))
                if grow and alive.any():
                    found = _grown(c.ids, np.arange(len(c.ids)), c.counts, c.h, at[alive], n)
                    yield _doc_rows([c.id], [None], [None], [None], [None], [None], [None], [None], [_squeezed(**found, best=_best({}, found))])

    return run


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _doc_rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _DOC_KINDS, strict=True)], names=[x.split()[0] for x in _DOC_SCHEMA.split(", ")])


def _best(before: dict, found: dict) -> dict:
    """The longest length at which each document of a chunk still has a repeated window."""
    return before | dict.fromkeys(np.unique(found["doc"]).tolist(), found["length"])


def _doubled(bits: int):
    """Ask for windows of twice the length: both halves of each have repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                if row["state"] is None:  # a later round: take in its answers first
                    state, replies = _parted(row["replies"])
                    state = _answered(state, replies)
                else:
                    state = _opened(row["state"])
                n = state["length"]
                r = Runs(state["ids"], state["doc"], state["size"], state["table"][state["code"]])
                alive = np.zeros(len(r.last) + 1, bool)
                alive[np.cumsum(state["alive"], dtype=np.int64)] = True
                at = r.whole(2 * n)
                at = at[alive[at] & alive[at + n]]
                yield _ask(row["chunk_id"], r.distinct(at, 2 * n), bits, True, _squeezed(**state, asked=np.diff(at, prepend=0).astype(np.int32)))

    return run


def _answered(state: dict, replies: list[dict]) -> dict:
    n = 2 * state["length"]
    h = state["table"][state["code"]]
    at = np.cumsum(state.pop("asked"), dtype=np.int64)
    order, group, *_ = Runs(state["ids"], state["doc"], state["size"], h).distinct(at, n)
    found = _grown(state["ids"], state["doc"], state["size"], h, at[order][_bits(replies, "alive")[group]], n)
    return found | {"best": _best(state["best"], found)}


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk_id, state in zip(batch.column("chunk_id").to_pylist(), batch.column("alive").to_pylist(), strict=True):
            best = _opened(state)["best"]
            yield pa.RecordBatch.from_arrays([pa.array([chunk_id] * len(best), pa.int64()), pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["chunk_id", "k", "longest"])


def _exchange(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers and states as written, the same gathered by chunk)"""
    got = materialise(asks.groupBy("bucket").applyInArrow(_answer, _REPLY_SCHEMA))
    return got, got.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "n", "alive", "earlier")).alias("replies"))


def substring_dedup(docs: DataFrame, min_words: int = 13, grow: bool = False, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Remove words of passages that also start in a document with a smaller doc_id.

    A word is removed if a window of ``min_words`` consecutive words of its document covers it
    and that word sequence also starts in a document with a smaller ``doc_id``; windows are judged
    on the input. Words are maximal runs without white space (space, U+0009-U+000D).

    Input: any DataFrame with ``doc_id`` (integer) and ``text``; further columns are ignored.
    Output: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space);
    with ``with_text`` kept (the kept words joined by one space, or the text itself if nothing is
    removed; null for a null text) and text_key (``xxhash64`` of the text, as the engine has it); with ``grow`` longest: windows that repeat in another document
    are extended to twice their length, again and again until no candidate survives, and the longest
    length of ``min_words`` * 2**k at which the document still has one is returned, 0 if it has none.

    Null and empty texts have no words and are returned with counts of 0. Texts under ``min_words``
    words keep all. Rows that repeat a doc_id count as one document. An empty table gives an empty
    result. A null doc_id counts as smaller than all others and is returned as null.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = documents(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))))
    lengths = [(min_words + 1) // 2, min_words]
    chunks = materialise(docs.mapInArrow(lambda it: pack_chunks(it, chunk), _CHUNK_SCHEMA), "none")
    total = chunks.agg(F.sum(F.expr("octet_length(text)"))).first()[0] or 0
    # about 3 bytes of text in a byte of the chunk, 6 bytes in a word, an anchor for 4 words
    bits = max(0, min(24, int(np.ceil(np.log2(max(1, total * 3 / 6 / 4 / ENTRIES))))))
    before, own = _exchange(chunks.mapInArrow(_asks(0, lengths, bits), _ASK_SCHEMA))
    got, own = _exchange(chunks.join(own, "chunk_id").mapInArrow(_asks(1, lengths, bits), _ASK_SCHEMA))
    discard(before)
    out = chunks.join(own, "chunk_id").mapInArrow(_texts(lengths, with_text, grow), _DOC_SCHEMA)
    if grow:
        found = materialise(out)
        discard(chunks, got)
        asking = found.filter("state is not null").select("chunk_id", "state", F.lit(None).cast(own.schema["replies"].dataType).alias("replies"))
        got = None
        while True:
            before = got
            got, own = _exchange(asking.mapInArrow(_doubled(bits), _ASK_SCHEMA))
            if before is not None:
                discard(before)
            if not got.filter("n_alive > 0").limit(1).count():
                break
            asking = own.select("chunk_id", F.lit(None).cast("binary").alias("state"), "replies")
        best = got.filter("bucket < 0").select("chunk_id", "alive").mapInArrow(_longest, "chunk_id long, k int, longest long")
        out = found.filter("state is null").join(best, ["chunk_id", "k"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long"))
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["longest"] if grow else []), *(["kept", "text_key"] if with_text else []))


_LEVELS = [13 << k for k in range(12)]  # lengths that the SQL goes through: documents of the tables it is for have fewer than 2 * 13 * 2**11 words
_LEVEL = "l{n} AS (SELECT doc_id, i, c FROM (SELECT {a}doc_id, {a}i, min(CAST({a}doc_id AS BIGINT) * 1000000 + {a}i) OVER p AS c, min({a}doc_id) OVER p AS low, max({a}doc_id) OVER p AS high FROM {rows} WINDOW p AS (PARTITION BY {key})) WHERE low < high)"
SQL = (
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM w),
m AS (SELECT t, min(doc_id) AS low FROM g GROUP BY t),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN m USING (t) WHERE m.low < g.doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT word.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS kept
      FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id),
"""
    + ",\n".join(_LEVEL.format(n=n, a="", rows="g", key="t") if n == 13 else _LEVEL.format(n=n, a="a.", rows=f"l{n // 2} a JOIN l{n // 2} b ON a.doc_id = b.doc_id AND b.i = a.i + {n // 2}", key="a.c, b.c") for n in _LEVELS)
    + ",\nx AS (SELECT doc_id, max(n) AS longest FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {n} AS n FROM l{n}" for n in _LEVELS)
    + """) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256, CAST(coalesce(x.longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN x USING (doc_id)
"""
)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), grow=True)
