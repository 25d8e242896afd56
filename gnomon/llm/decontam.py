"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into shards of a bounded size. A shard's index stores, for every
word of its texts, the sorted positions of its occurrences; it is written once, its
terms in buckets by hash, each bucket in columns of its own, so that a search reads
only the buckets of the terms it asks for. Windows are found by intersecting the
position lists of their terms, each shifted by the term's offset, from the rarest
term of the shard on; proximity by sweeping the lists of all terms.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import U64, documents, materialise, packed, release, slices, table, utf8, word_hashes, words

SHARD = 4_000_000  # bytes of text in a shard
QUERY_BYTES = 16_000_000  # text of items that one search carries to all shards; more are searched in turns
BUCKETS = 8  # of terms, by the first bits of their hashes
_PARTS = ("terms", "offsets", "places")
_INDEX = "shard long, doc_ids binary, firsts binary, " + ", ".join(f"{x}_{k} binary" for k in range(BUCKETS) for x in _PARTS)

# Words are runs of lower-case letters, digits and anything beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[0x30:0x3A] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and one more) of lower-cased rows."""
    data = _LOWER[data]
    start, end, first = words(data, offsets, _BREAK)
    return word_hashes(data, start, end), first


def text_terms(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return term_hashes(raw, np.array([0, len(raw)]))[0]


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Positional postings of all words, a row a shard, written once.

    Words are numbered through a shard with a gap of one between documents, so that no phrase
    crosses one. Every document is in exactly one shard, with all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, shard):
                h, first = term_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = [(part << 32) + seq, packed(ids[a:b]), packed(first), *_postings(h, first)]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] + [pa.binary()] * (len(row) - 1), strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    source = documents(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    return materialise(source.mapInArrow(run, _INDEX))


def _postings(h: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """For each bucket: its terms in order, where each one's list begins and ends, and the lists as steps."""
    order = np.argsort(h, kind="stable")  # lists stay in order of position
    term, place = h[order], order + np.searchsorted(first, order, "right") - 1
    for a, b in zip(*(np.searchsorted(term >> U64(61), np.arange(BUCKETS) + x) for x in (0, 1)), strict=True):
        t = term[a:b]
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
        yield packed(t[cut])
        yield packed(np.append(cut, len(t)).astype(np.uint32))
        yield packed(np.diff(place[a:b], prepend=0).astype(np.uint32))


_NO_ID = -(1 << 63)  # stands for a null doc_id while numbers are packed


def asked(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """The columns of the index that hold these terms."""
    return index.select("shard", "doc_ids", "firsts", *(f"{x}_{k}" for k in np.unique(terms >> U64(61)).tolist() for x in _PARTS))


class Shard:
    """A shard's documents and the postings of the buckets that were read."""

    def __init__(self, row: dict):
        self.id = row["shard"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.first = np.frombuffer(row["firsts"], np.int64)
        self.counts = np.diff(self.first)
        self.starts = self.first[:-1] + np.arange(len(self.ids))  # of each document, with the gaps
        self.total = int(self.starts[-1] + self.counts[-1]) if len(self.ids) else 0
        here = [k for k in range(BUCKETS) if f"terms_{k}" in row]
        parts = [[np.frombuffer(row[f"{x}_{k}"], t) for x, t in zip(_PARTS, (U64, np.uint32, np.uint32), strict=True)] for k in here]
        self.terms = np.concatenate([np.empty(0, U64), *(t for t, _, _ in parts)])
        size = np.concatenate([np.empty(0, np.int64), *(np.diff(o.astype(np.int64)) for _, o, _ in parts)])
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.places = np.concatenate([np.empty(0, np.int64), *(np.cumsum(p, dtype=np.uint32).astype(np.int64) for _, _, p in parts)])

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 where the shard does not have it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def phrases(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which phrase, position) of all places where a phrase's terms stand one after the other.

        ``lists`` holds a phrase a row as the numbers of its terms' lists. Each phrase starts from the
        list of its rarest term; what is left is looked up in the list of the next rarest, and so on.
        """
        df = np.diff(self.offsets)[lists]
        by = np.argsort(df, axis=1, kind="stable")
        row = np.arange(len(lists))
        rarest = lists[row, by[:, 0]]
        n = self.offsets[rarest + 1] - self.offsets[rarest]
        which = np.repeat(row, n)
        at = self.places[np.repeat(self.offsets[rarest] - np.cumsum(n) + n, n) + np.arange(n.sum())] - np.repeat(by[:, 0], n)
        if self.keys is None:  # (list, position) of all postings, in order
            self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) * (self.total + 1) + self.places
        for turn in range(1, lists.shape[1]):
            k = by[which, turn]
            key = lists[which, k] * (self.total + 1) + at + k
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[j] == key) & (at >= 0) & (at + k <= self.total)
            which, at = which[ok], at[ok]
            if not len(at):
                break
        return which, at

    keys: np.ndarray | None = None

    def postings(self, term: int) -> np.ndarray:
        """Positions of a term, by its hash."""
        k = int(self.rank(np.array([term], U64))[0])
        return self.places[self.offsets[k] : self.offsets[k + 1]] if k >= 0 else self.places[:0]

    def near(self, terms: list[int], within: int) -> np.ndarray:
        """Starts of the spans of at most ``within`` words of one document that hold all the terms."""
        lists = [self.postings(t) for t in set(terms)]
        if not lists or not all(map(len, lists)):
            return self.places[:0]
        start = np.unique(np.concatenate(lists))
        last = start.copy()
        ok = np.ones(len(start), bool)
        for found in lists:
            j = np.searchsorted(found, start)
            ok &= j < len(found)
            last = np.maximum(last, found[np.minimum(j, len(found) - 1)])
        doc = np.searchsorted(self.starts, start, "right")
        return start[ok & (last - start < within) & (doc == np.searchsorted(self.starts, last, "right"))]


def windows(item: np.ndarray, size: int) -> np.ndarray:
    """All windows of ``size`` terms, a row each; an item of fewer, but not none, is one window."""
    if not len(item):
        return np.empty((0, size), item.dtype)
    return np.lib.stride_tricks.sliding_window_view(item, min(size, len(item)))


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    held = 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if block and held + len(r["text"] or "") * 4 > limit:
            yield block
            block, held = [], 0
        block.append((r["item_id"], text_terms(r["text"])))
        held += len(r["text"] or "") * 4
    yield block


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, limit: int = QUERY_BYTES) -> DataFrame:
    """Words of documents inside occurrences of benchmark windows.

    A window is ``size`` consecutive words of an item, or a whole shorter one. Words are runs of
    letters, digits and non-ASCII after A-Z are lower-cased. Output per document: doc_id, n_words,
    n_hit, n_items, items_sha256 (of the ids of items with windows in it, sorted as strings, joined
    by commas), contaminated (n_hit > 0 and ``share`` * n_hit >= n_words) and hits (the hit words as
    packed bits, lowest first).

    The index is written once; items are searched in blocks of at most ``limit`` bytes. Null and empty
    texts have no words, on either side; without items nothing is hit. Items that repeat an id count
    once; items with a null id count as one more, which the digest leaves out. Repeated and null
    doc_ids keep a row each. An empty table of documents gives no rows.
    """
    index, found = build_index(docs), []
    for block in _item_blocks(items, limit):
        names = list(dict.fromkeys(name for name, _ in block))
        by_size: dict[int, tuple[list, list]] = {}
        number = {n: k for k, n in enumerate(names)}
        for name, terms in block:
            w = windows(terms, size)
            rows, owners = by_size.setdefault(w.shape[1], ([], []))
            rows.append(w)
            owners.append(np.full(len(w), number[name]))
        want = [(np.concatenate(rows), np.concatenate(owners)) for rows, owners in by_size.values()]
        found.append(_search(index, [x for x in want if len(x[0])], names, share))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    if len(found) > 1:  # a document's row is its place in the index, which was written once
        whole = whole.groupBy("row").applyInArrow(_joined(share), _FOUND)
    out = whole.drop("row", "items")
    out.index = index  # for a caller to discard once the result is taken
    return out


_FOUND = "row string, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits binary, items array<string>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] + [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _row(key: str, doc: int | None, n: int, hit: np.ndarray, items: set, share: int) -> tuple:
    names = sorted(x for x in items if x is not None)
    k = int(hit.sum())
    return key, doc, n, k, len(items), hashlib.sha256(",".join(names).encode()).hexdigest(), k > 0 and share * k >= n, packed(np.packbits(hit, bitorder="little")), list(items)


def _joined(share: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        n, items = rows[0]["n_words"], set()
        hit = np.zeros(n, bool)
        for r in rows:
            hit |= np.unpackbits(np.frombuffer(r["hits"], np.uint8), count=n, bitorder="little").astype(bool)
            items.update(r["items"])
        return pa.Table.from_batches([_rows([_row(rows[0]["row"], rows[0]["doc_id"], n, hit, items, share)])])

    return run


def _search(index: DataFrame, want: list[tuple[np.ndarray, np.ndarray]], names: list, share: int) -> DataFrame:
    """Documents with what a block of items hits: ``want`` has windows of one size each, and the number of each one's item."""
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps((want, names)))  # bounded by the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        want, names = pickle.loads(shared.value)
        vocabulary = np.unique(np.concatenate([np.empty(0, U64), *(w.ravel() for w, _ in want)]))
        sets = [(np.searchsorted(vocabulary, w), owner) for w, owner in want]
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard(batch.slice(k, 1).to_pylist()[0])
                rank = s.rank(vocabulary)
                edge = np.zeros(s.total + 1, np.int64)
                pairs = []
                for w, owner in sets:
                    lists = rank[w]
                    live = np.flatnonzero((lists >= 0).all(1))  # windows of whose terms the shard has every one
                    if not len(live):
                        continue
                    which, at = s.phrases(lists[live])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + w.shape[1], -1)
                    doc = np.searchsorted(s.starts, at, "right") - 1
                    pairs.append(np.unique(doc * len(names) + owner[live[which]]))
                items: dict[int, set] = {}
                for pair in np.concatenate(pairs).tolist() if pairs else []:
                    items.setdefault(pair // len(names), set()).add(names[pair % len(names)])
                hit = np.cumsum(edge)[: s.total] > 0
                out = []
                for d in range(len(s.ids)):
                    a, n = int(s.starts[d]), int(s.counts[d])
                    out.append(_row(f"{s.id}-{d}", None if s.ids[d] == _NO_ID else int(s.ids[d]), n, hit[a : a + n], items.get(d, set()), share))
                    if len(out) == 5000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    terms = np.concatenate([np.empty(0, U64), *(w.ravel() for w, _ in want)])
    return asked(index, terms).mapInArrow(run, _FOUND)


def proximity(docs: DataFrame, phrase: str, within: int) -> DataFrame:
    """(doc_id, n_spans): documents with spans of at most ``within`` words that hold all words of ``phrase``."""
    terms = text_terms(phrase)
    want = terms.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for raw in batch.to_pylist():
                s = Shard(raw)
                doc, n = np.unique(np.searchsorted(s.starts, s.near(want, within), "right") - 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[doc]), pa.array(n)], names=["doc_id", "n_spans"])

    return asked(build_index(docs), terms).mapInArrow(run, "doc_id long, n_spans long")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT item_id, unnest(range(1, greatest(2, len(ws) - 11))) AS i, ws FROM b WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, len(ws[i:i + 12]) AS n, array_to_string(ws[i:i + 12], ' ') AS t FROM w),
sizes AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM p),
m AS (SELECT g.doc_id, g.i, g.n, q.item_id FROM g JOIN q ON g.t = q.t AND g.n = q.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")
