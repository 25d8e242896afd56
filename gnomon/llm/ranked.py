"""Ranked lexical search by MaxScore over shards of an inverted index.

The index is written once: a row a shard, its terms in buckets by hash, each with the documents that hold
it and how often. A search computes the corpus statistics of its terms by a grouped sum, then visits every
shard: the largest part that a term can add there is its bound. For each item, the terms with the
smallest bounds, which together cannot reach the tenth best score so far, are non-essential: documents
come from the lists of the other terms alone, and non-essential lists are looked up only for
documents that can still qualify.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gnomon.llm.common import U64, documents, materialise, packed, release, slices, table, utf8
from gnomon.llm.decontam import _BREAK, _LOWER, term_hashes, text_terms

SHARD = 16_000_000  # bytes of text in a shard, or one longer text
PIECE = 4_000_000  # bytes that are hashed at once; a longer text is cut between terms
QUERY_BYTES = 16_000_000  # text of items that one search carries to all shards; more are searched in turns
BUCKETS = 8  # of terms, by the first bits of their hashes
FIRST, STEP = 512, 4096  # documents of a shard that are scored before its bounds are used, and between later uses
_NO_ID = -(1 << 63)  # stands for a null doc_id while numbers are packed
_PARTS = ("terms", "cuts", "docs", "counts")
_INDEX = "shard long, n_docs long, n_terms long, doc_ids binary, sizes binary, " + ", ".join(f"{x}_{k} binary" for k in range(BUCKETS) for x in _PARTS)


def _hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Terms of one long text, in pieces that end at a byte of no term."""
    a = 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        while b < len(data):
            cut = np.flatnonzero(_BREAK[_LOWER[data[a:b]]])
            if len(cut):
                b = a + int(cut[-1]) + 1
                break
            b = min(b + PIECE, len(data))
        yield term_hashes(data[a:b], np.array([0, b - a]))[0]
        a = b


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Postings of all terms, a row a shard, written once: each text is in exactly one shard, with all its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(sizes)
            row = [(part << 32) + seq, int((n > 0).sum()), int(n.sum()), packed(np.concatenate(ids)), packed(n.astype(np.uint32)), *_postings(np.concatenate(terms), n)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * (len(row) - 3), strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, PIECE):
                if held and held + offsets[b] - offsets[a] > shard:
                    yield flush()
                    seq, held = seq + 1, 0
                    ids, terms, sizes = [], [], []
                if b == a + 1:
                    h = np.concatenate([np.empty(0, U64), *_hashes(data[offsets[a] : offsets[b]])])
                    n = np.array([len(h)])
                else:
                    h, first = term_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    n = np.diff(first)
                ids.append(keys[a:b])
                terms.append(h)
                sizes.append(n)
                held += int(offsets[b] - offsets[a]) + 8 * (b - a)
        if ids:
            yield flush()

    source = documents(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    return materialise(source.mapInArrow(run, _INDEX))


def _postings(h: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    """For each bucket: its terms in order, where each one's list begins and ends, documents as steps, and occurrences."""
    order = np.argsort(h, kind="stable")  # lists stay in order of documents
    term, doc = h[order], np.repeat(np.arange(len(n), dtype=np.int64), n)[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    term, doc, count = term[at], doc[at], np.diff(np.append(at, len(order)))
    for a, b in zip(*(np.searchsorted(term >> U64(61), np.arange(BUCKETS) + x) for x in (0, 1)), strict=True):
        t = term[a:b]
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
        yield packed(t[cut])
        yield packed(np.append(cut, len(t)).astype(np.uint32))
        yield packed(np.diff(doc[a:b], prepend=0).astype(np.uint32))
        yield packed(count[a:b].astype(np.uint32))


def _lists(row: dict, buckets: list[int], terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each bucket: (bucket, which of ``terms`` it has, first and last posting of each)."""
    for k in buckets:
        have = np.frombuffer(row[f"terms_{k}"], U64)
        want = np.flatnonzero(terms >> U64(61) == U64(k))
        if len(have) and len(want):
            j = np.minimum(np.searchsorted(have, terms[want]), len(have) - 1)
            ok = have[j] == terms[want]
            cut = np.frombuffer(row[f"cuts_{k}"], np.uint32).astype(np.int64)
            yield k, want[ok], cut[j[ok]], cut[j[ok] + 1]


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The m of documents of n terms; whole numbers of any size where 64 bits would not do."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
    return 10 + 90 * n * docs // max(1, terms)


class Best:
    """The best documents of one item so far."""

    __slots__ = ("ids", "keep", "scores")

    def __init__(self, keep: int):
        self.keep, self.scores, self.ids = keep, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """What a document must score to be among them, unless its id decides."""
        return int(self.scores[-1]) if len(self.scores) == self.keep else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        by = np.lexsort((np.where(ids == _NO_ID, np.iinfo(np.int64).max, ids), -scores))[: self.keep]
        self.scores, self.ids = scores[by], ids[by]


class Shard:
    """The lists of the asked terms in one shard, with what each posting adds and each list's bound."""

    def __init__(self, row: dict, buckets: list[int], terms: np.ndarray, weights: np.ndarray, docs: int, total: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        m = _lengths(np.frombuffer(row["sizes"], np.uint32).astype(np.int64), docs, total)
        self.place = np.full(len(terms), -1)
        found, starts, parts, adds, n = [], [0], [], [], 0
        for k, which, a, b in _lists(row, buckets, terms):
            place = np.cumsum(np.frombuffer(row[f"docs_{k}"], np.uint32), dtype=np.uint32)
            count = np.frombuffer(row[f"counts_{k}"], np.uint32)
            size = b - a
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            doc = place[at].astype(np.int64)
            self.place[which] = n + np.arange(len(which))
            n += len(which)
            found.append(which)
            starts.extend((starts[-1] + np.cumsum(size)).tolist())
            parts.append(doc)
            adds.append(np.repeat(weights[which], size) * _impact(count[at].astype(np.int64), m[doc]))
        self.starts = np.array(starts)
        self.docs = np.concatenate([np.empty(0, np.int64), *parts])
        self.adds = np.concatenate([np.empty(0, np.int64), *adds])
        self.bounds = np.maximum.reduceat(self.adds, self.starts[:-1]) if len(self.adds) else np.empty(0, np.int64)

    def search(self, item: np.ndarray, best: Best, prune: bool = True) -> int:
        """Raise ``best`` by the documents here; how many postings were looked at. ``item``: its terms' numbers."""
        lists = self.place[item]
        lists = lists[lists >= 0]
        lists = lists[np.argsort(self.bounds[lists], kind="stable")]
        reach = np.cumsum(self.bounds[lists])  # of the lists up to each one
        edges = [0, *range(FIRST, len(self.ids), STEP), len(self.ids)] if len(self.ids) > FIRST else [0, len(self.ids)]
        looked = 0
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            need = best.least() if prune else 1
            few = int(np.searchsorted(reach, need))  # lists that together stay below it
            if few == len(lists):
                break
            at, adds = [], []
            for x in lists[few:].tolist():
                a, b = self.starts[x], self.starts[x + 1]
                if high - low < len(self.ids):
                    a, b = a + np.searchsorted(self.docs[a:b], (low, high))
                at.append(self.docs[a:b])
                adds.append(self.adds[a:b])
            at, adds = np.concatenate(at), np.concatenate(adds)
            looked += len(at)
            sums = np.bincount(at - low, adds, high - low).astype(np.int64)  # whole numbers below 2**53
            doc = np.flatnonzero(sums)
            score = sums[doc]
            for q in range(few - 1, -1, -1):
                ok = score + reach[q] >= need
                doc, score = doc[ok], score[ok]
                if not len(doc):
                    break
                a, b = self.starts[lists[q]], self.starts[lists[q] + 1]
                own = self.docs[a:b]
                j = np.minimum(np.searchsorted(own, doc + low), len(own) - 1)
                score = score + np.where(own[j] == doc + low, self.adds[a + j], 0)
                looked += len(doc)
            ok = score >= need
            if ok.any():
                best.add(score[ok], self.ids[doc[ok] + low])
        return looked


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Items with their terms, each once; rows that share an id are one item."""
    block: list[tuple] = []
    held, text, now, begun = 0, [], None, False

    def terms() -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, U64), *text]))

    for r in items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        if begun and r["item_id"] != now:
            block.append((now, terms()))
            text = []
            if held > limit:
                yield block
                block, held = [], 0
        now, begun = r["item_id"], True
        text.append(np.unique(text_terms(r["text"])))
        held += 8 * len(text[-1]) + 64
    if begun:
        block.append((now, terms()))
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, keep: int = 10, limit: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``keep`` best documents with a score above 0.

    Terms are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased; with N documents that
    have a term, L terms in them, a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document of n terms
    has m = 10 + 90nN div L, and scores the sum of weight * ((10**9 tf) div (1000 tf + 8m)) over the
    item's terms, each once. Equal scores rank by ascending doc_id, null doc_ids last.

    Null and empty texts have no terms, on either side. Each row of ``docs`` is a document, also where
    doc_ids repeat or are null; rows of ``items`` that share an item_id, null included, are one item with all
    their terms. Items without a hit and empty tables give no rows. Terms are told apart by 64-bit hashes.
    Items go to all shards in blocks of at most about ``limit`` bytes of term hashes.
    """
    index = build_index(docs)
    sums = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n, total = sums["docs"] or 0, sums["terms"] or 0
    kind = items.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"
    whole = docs.sparkSession.createDataFrame([], schema)
    for block in _item_blocks(items, limit):
        whole = whole.unionByName(_search(index, block, n, total, keep, schema, to_arrow_type(kind)))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = whole.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= keep)
    out.index = index  # for a caller to discard once the result is taken
    return out


def _search(index: DataFrame, block: list[tuple], n: int, total: int, keep: int, schema: str, kind: pa.DataType) -> DataFrame:
    """The best documents of each task for a block of items."""
    spark = index.sparkSession
    names = [name for name, _ in block]
    vocabulary = np.unique(np.concatenate([np.empty(0, U64), *(t for _, t in block)]))
    wanted = [np.searchsorted(vocabulary, t) for _, t in block]
    buckets = np.unique(vocabulary >> U64(61)).tolist()
    terms = spark.sparkContext.broadcast(pickle.dumps(vocabulary))  # bounded by the block

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocabulary = pickle.loads(terms.value)
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for _, which, a, b in _lists(row, buckets, vocabulary):
                    df[which] += b - a
        which = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(df[which])], names=["term", "df"])

    counted = index.select(*(f"{x}_{k}" for k in buckets for x in ("terms", "cuts"))).mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(counted.column("term").to_pylist(), counted.column("df").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    asked = spark.sparkContext.broadcast(pickle.dumps((vocabulary, weights, wanted, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocabulary, weights, wanted, names = pickle.loads(asked.value)
        best = [Best(keep) for _ in names]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], buckets, vocabulary, weights, n, total)
                for item, b in zip(wanted, best, strict=True):
                    shard.search(item, b)
        for a in range(0, len(best), 2000):
            some = best[a : a + 2000]
            ids = np.concatenate([np.empty(0, np.int64), *(b.ids for b in some)])
            who = [name for name, b in zip(names[a : a + 2000], some, strict=True) for _ in range(len(b.ids))]
            yield pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([np.empty(0, np.int64), *(b.scores for b in some)]))], names=["item_id", "doc_id", "score"])

    return index.select("doc_ids", "sizes", *(f"{x}_{k}" for k in buckets for x in _PARTS)).mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
m AS (SELECT doc_id, 10 + (90 * n.n * c.N) // c.L AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c.N + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, c.N),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
