"""Hard negatives by inner product, bracketed by a table of pivot distances.

Each vector v gets one more component, sqrt(M^2 - |v|^2), M the largest norm; an anchor gets 0 there. Then
|a - v|^2 = |a|^2 + M^2 - 2 a.v: the largest inner product is the smallest distance. The table, written once,
holds blocks of near rows with their distances from a few pivots. By the triangle inequality the
distances of a and v from a pivot bracket |a - v|, hence the score; whole blocks, then single rows, fall
out, and what survives is scored exactly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gnomon.llm.common import materialise, packed, release, table

PIVOTS = 16
SAMPLE = 512  # vectors that pivots are chosen from
BLOCK = 2048  # rows of a block
ANCHOR_BYTES = 16_000_000  # vectors of anchors that one search carries to all blocks; more are searched in turns
TILE = 256  # anchors that are held against a block at once
SLACK = 1e-5  # of M: what rounding can do to a distance, many times over
_NONE = int(np.iinfo(np.int64).min)  # no score yet; also stands for a null id while numbers are packed
_TABLE = "block long, ids binary, labels binary, anchors binary, vectors binary, distances binary, nearest binary, farthest binary"


class Space:
    """What all vectors share: largest norm squared, components, their size, and the pivots."""

    def __init__(self, norm: float, dim: int, largest: float):
        self.norm, self.dim, self.largest = norm, dim, largest
        self.exact = dim * largest * largest < 2**53  # then sums of products are exact in doubles
        self.kind = np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64
        self.pivots, self.lifts = np.zeros((0, dim)), np.zeros(0)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """The component that makes all norms M."""
        return np.sqrt(np.maximum(0, self.norm - (vectors * vectors).sum(1)))

    def choose(self, sample: np.ndarray, k: int = PIVOTS) -> None:
        """Pivots far from each other: each next one is the farthest from those before it."""
        if not len(sample):
            return
        lift, picked = self.lift(sample), [0]
        away = np.full(len(sample), np.inf)
        while len(picked) <= min(k, len(sample)):
            last = picked[-1]
            away = np.minimum(away, ((sample - sample[last]) ** 2).sum(1) + (lift - lift[last]) ** 2)
            if away.max() <= 0:
                break
            picked.append(int(away.argmax()))
        picked = picked[1:] if len(picked) > k else picked  # the first was any row
        self.pivots, self.lifts = sample[picked], lift[picked]

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of rows from the pivots, a row each."""
        return np.sqrt(np.maximum(0, 2 * self.norm - 2 * (vectors @ self.pivots.T) - 2 * self.lift(vectors)[:, None] * self.lifts))

    def of_anchors(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (vectors * vectors).sum(1)[:, None] + self.norm - 2 * (vectors @ self.pivots.T)))

    def scores(self, a: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products of each row of ``a`` with each of ``v``, as whole numbers."""
        if self.exact:
            return (a @ v.T).astype(np.int64)
        return _whole(_ints(a) @ _ints(v).T)

    def pairs(self, a: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products row by row."""
        if self.exact:
            return np.einsum("ij,ij->i", a, v).astype(np.int64)
        return _whole((_ints(a) * _ints(v)).sum(1)) if len(a) else np.empty(0, np.int64)


def _ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)


def _whole(x: np.ndarray) -> np.ndarray:
    if x.size and max(map(abs, x.ravel())) >= 2**62:
        raise ValueError("a score does not fit 64 bits")
    return x.astype(np.int64)


def _vectors(column, dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _space(rows: DataFrame) -> Space:
    """Norms of all rows; pivots from SAMPLE distinct vectors chosen by hash."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    size = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(0.0))
    found = rows.agg(F.max(norm).alias("norm"), F.max(F.size("vector")).alias("dim"), F.max(size).alias("size")).first()
    space = Space(found["norm"] or 0.0, found["dim"] or 0, found["size"] or 0.0)
    chance = F.xxhash64("vector")
    some = rows.select(chance.alias("chance"), "vector").groupBy("chance").agg(F.min("vector").alias("vector")).orderBy("chance").limit(SAMPLE).toArrow()
    space.choose(_vectors(some.column("vector"), space.dim))
    return space


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """Blocks of rows that lie near each other: by label, nearest pivot and distance from it; written once.

    ``rows``: id long, label long, anchor boolean, vector array<double> of whole numbers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(space))  # some pivots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = pickle.loads(shared.value)
        for batch in batches:
            v = _vectors(batch.column("vector"), space.dim)
            d = space.of_rows(v)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(v), np.int64)
            far = d.min(1) if d.shape[1] else np.zeros(len(v))
            raw = v.astype(space.kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(near.astype(np.int64)), pa.array(far)], names=["id", "label", "anchor", "vector", "near", "far"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        space = pickle.loads(shared.value)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                raw = np.frombuffer(b"".join(some.column("vector").to_pylist()), space.kind).reshape(some.num_rows, space.dim)
                d = space.of_rows(raw.astype(np.float64)).astype(np.float32)
                ids = some.column("id").fill_null(_NONE).to_numpy()
                row = [(part << 32) + seq * BLOCK, packed(ids), packed(some.column("label").to_numpy()), packed(some.column("anchor").to_numpy(zero_copy_only=False)), packed(raw), packed(d.T), packed(d.min(0)), packed(d.max(0))]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] + [pa.binary()] * 7, strict=True)], names=[x.split()[0] for x in _TABLE.split(", ")])

    placed = rows.mapInArrow(place, "id long, label long, anchor boolean, vector binary, near long, far double").withColumn("row", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange("label", "near", "far", "id", "row").sortWithinPartitions("label", "near", "far", "id", "row")
    return materialise(dealt.mapInArrow(blocks, _TABLE))


class Block:
    def __init__(self, row: dict, space: Space):
        self.first = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], space.kind).reshape(len(self.ids), space.dim).astype(np.float64)
        self.distances = np.frombuffer(row["distances"], np.float32).reshape(len(space.pivots), len(self.ids))
        self.nearest, self.farthest = (np.frombuffer(row[k], np.float32) for k in ("nearest", "farthest"))

    def survivors(self, away: np.ndarray, most: np.ndarray, least: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) whose distance may lie in [least, most] of the anchor, whose distances from the pivots are ``away``."""
        who = np.flatnonzero((np.maximum(away - self.farthest, self.nearest - away).max(1, initial=0) <= most) & ((away + self.farthest).min(1, initial=np.inf) >= least))
        n = rows.stop - rows.start
        if not len(who) or not n:
            return who[:0], who[:0]
        alive, a, r = np.ones((len(who), n), bool), None, None
        for p in range(len(self.distances)):
            d = self.distances[p, rows]
            if a is None:
                q = away[who, p][:, None].astype(np.float32)
                alive &= np.abs(q - d) <= most[who][:, None]
                alive &= q + d >= least[who][:, None]
                if p % 4 == 3 and np.count_nonzero(alive) < alive.size // 8:
                    a, r = np.nonzero(alive)
            else:
                q = away[who[a], p]
                ok = (np.abs(q - d[r]) <= most[who[a]]) & (q + d[r] >= least[who[a]])
                a, r = a[ok], r[ok]
        if a is None:
            a, r = np.nonzero(alive)
        return who[a], r + rows.start


def _check(space: Space, block: Block, vectors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of the surviving pairs: by one product where most pairs of their anchors and rows survive."""
    if not len(a):
        return np.empty(0, np.int64)
    anchors, x = np.unique(a, return_inverse=True)
    rows, y = np.unique(r, return_inverse=True)
    if len(a) * 8 >= len(anchors) * len(rows):
        return space.scores(vectors[anchors], block.vectors[rows])[x, y]
    step = max(1, 4_000_000 // max(1, space.dim))
    return np.concatenate([space.pairs(vectors[a[k : k + step]], block.vectors[r[k : k + step]]) for k in range(0, len(a), step)])


class Best:
    """The best entries of many groups: by descending score, then ascending id, nulls last."""

    def __init__(self, groups: int, keep: int, least: np.ndarray | None = None):
        self.keep = keep
        self.group, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = np.full(groups, _NONE) if least is None else least.copy()  # of the last entry of each full group, or a score that as many are known to reach

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least[group]
        if not ok.any():
            return
        touched = np.zeros(len(self.least), bool)
        touched[group[ok]] = True
        old = touched[self.group]
        g, s, i = (np.concatenate([x[old], y[ok]]) for x, y in ((self.group, group), (self.score, score), (self.id, ids)))
        by = np.lexsort((np.where(i == _NONE, np.iinfo(np.int64).max, i), -s, g))
        g, s, i = g[by], s[by], i[by]
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        rank = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
        last = rank == self.keep - 1
        self.least[g[last]] = s[last]
        ok = rank < self.keep
        self.group, self.score, self.id = (np.concatenate([x[~old], y[ok]]) for x, y in ((self.group, g), (self.score, s), (self.id, i)))


class Anchors:
    """A block of anchors: what a search carries to all blocks of the table."""

    def __init__(self, rows: list, space: Space):
        self.keys = np.array([r["key"] for r in rows], np.int64)
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), space.kind).reshape(len(rows), space.dim)

        self.floors = np.array([r["floor"] for r in rows], np.int64)

    def ready(self, space: Space) -> Anchors:
        self.vectors = self.vectors.astype(np.float64)
        self.away = space.of_anchors(self.vectors)
        self.norms = (self.vectors * self.vectors).sum(1)
        return self

    def radius(self, space: Space, who: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor's score would be ``score``."""
        return np.sqrt(np.maximum(0, self.norms[who] + space.norm - 2 * score.astype(np.float64)))


def _positives(space: Space, anchors: Anchors, block: Block, best: Best) -> int:
    """Raise the best rows of the anchors' own labels; how many pairs were scored."""
    scored, edge = 0, SLACK * math.sqrt(space.norm)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block.labels)) + 1, [len(block.labels)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = np.flatnonzero(anchors.labels == block.labels[low])
        for k in range(0, len(mine), TILE):
            who = mine[k : k + TILE]
            known = best.least[who]
            most = np.where(known == _NONE, np.inf, anchors.radius(space, who, known) + edge)
            a, r = block.survivors(anchors.away[who], most, np.zeros(len(who)), slice(low, high))
            ok = block.first + r != anchors.keys[who[a]]
            a, r = a[ok], r[ok]
            best.add(who[a], _check(space, block, anchors.vectors[who], a, r), block.ids[r])
            scored += len(a)
    return scored


def _negatives(space: Space, anchors: Anchors, limits: np.ndarray, block: Block, best: Best) -> int:
    """Raise the best rows of other labels in each positive's window [ceil(low), high]; ``limits``: (anchors, positives, 2), empty windows reversed."""
    scored, edge = 0, SLACK * math.sqrt(space.norm)
    n, each = limits.shape[:2]
    for k in range(0, n, TILE):
        who = np.arange(k, min(n, k + TILE))
        known = best.least.reshape(n, each)[who]
        low = np.maximum(limits[who, :, 0], known)
        low = np.where(limits[who, :, 0] > limits[who, :, 1], np.iinfo(np.int64).max, low)  # no such window
        floor, top = low.min(1, initial=np.iinfo(np.int64).max), limits[who, :, 1].max(1, initial=_NONE)
        some = floor <= top
        who, floor, top, low = who[some], floor[some], top[some], low[some]
        if not len(who):
            continue
        a, r = block.survivors(anchors.away[who], anchors.radius(space, who, floor) + edge, anchors.radius(space, who, top) - edge, slice(0, len(block.ids)))
        ok = block.labels[r] != anchors.labels[who[a]]
        a, r = a[ok], r[ok]
        score = _check(space, block, anchors.vectors[who], a, r)
        scored += len(a)
        for x in range(each):
            ok = (score >= low[a, x]) & (score <= limits[who[a], x, 1])
            if ok.any():
                best.add(who[a[ok]] * each + x, score[ok], block.ids[r[ok]])
    return scored


def _windows(positives: list[list[int]], each: int, low: int, high: int) -> np.ndarray:
    """For each anchor and positive: the least and the largest score with low * p <= 100 * score <= high * p; reversed where there is none."""
    out = np.empty((len(positives), each, 2), np.int64)
    out[:, :, 0], out[:, :, 1] = 1, 0
    for k, scores in enumerate(positives):
        for x, p in enumerate(scores):
            out[k, x] = (-(-low * p // 100), high * p // 100)
    return out


_ANCHOR = ["key", "id", "label", "floor", "vector"]


def _in_block(space: Space, row: dict, keep: int) -> list[dict]:
    """The anchors of one block of the table, each with a score that ``keep`` rows of its label reach there: near rows share a block, so that this is a high one."""
    at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
    block = Block(row, space)
    raw = np.frombuffer(row["vectors"], space.kind).reshape(-1, space.dim)
    out = [dict(zip(_ANCHOR, (row["block"] + k, int(block.ids[k]), int(block.labels[k]), _NONE, raw[k].tobytes()), strict=True)) for k in at.tolist()]
    best = Best(len(out), keep)
    if out:
        _positives(space, Anchors(out, space).ready(space), block, best)
    return [r | {"floor": int(x)} for r, x in zip(out, best.least, strict=True)]


def _anchor_blocks(found: DataFrame, limit: int) -> Iterator[list]:
    block, held = [], 0
    for r in found.toLocalIterator():
        block.append(r)
        held += len(r["vector"]) + 64
        if held > limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, limit: int = ANCHOR_BYTES) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label: the ``negatives`` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    ``rows``: id, label, vector (whole numbers); ``anchor`` is a condition on them, no anchor if null. Scores are
    integer inner products; higher ones come first, then smaller ids, null ids last. Rows with a null
    label, a null vector or a component that is null or not finite take no part; vectors shorter than the
    longest end in zeros. A row is no positive of itself; rows that repeat an id are rows of their own.
    Other columns are not looked at. An empty table, or no positive or negative, gives no rows. Scores beyond 62 bits are an error.

    The table is searched exactly, in turns of at most ``limit`` bytes of anchors.
    """
    spark = rows.sparkSession
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    plain = plain.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    space = _space(plain)
    whole = pivot_table(plain, space)
    shared = spark.sparkContext.broadcast(pickle.dumps(space))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = pickle.loads(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                found = _in_block(space, row, positives)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(_ANCHOR, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=_ANCHOR)

    picked = whole.mapInArrow(pick, "key long, id long, label long, floor long, vector binary")
    parts = []
    for block in _anchor_blocks(picked, limit):
        parts.append(_turn(whole, shared, Anchors(block, space), positives, negatives, low, high))
    out = parts[0] if parts else spark.createDataFrame([], _OUT)
    for more in parts[1:]:
        out = out.unionByName(more)
    out.table = whole  # for a caller to discard once the result is taken
    return out


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "`group` long, score long, id long"


def _entries(best: Best) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(best.group), 10_000):
        g, s, i = (x[k : k + 10_000] for x in (best.group, best.score, best.id))
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(i, mask=i == _NONE)], names=["group", "score", "id"])


def _top(found: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep)


def _turn(whole: DataFrame, shared, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """One block of anchors: its positives over the whole table, then the negatives of each."""
    spark = whole.sparkSession
    first = spark.sparkContext.broadcast(pickle.dumps(anchors))  # bounded by the block

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        space = pickle.loads(shared.value)
        own = pickle.loads(first.value).ready(space)
        best = Best(len(own.keys), positives, own.floors)
        for batch in batches:
            for k in range(batch.num_rows):
                _positives(space, own, Block(batch.slice(k, 1).to_pylist()[0], space), best)
        yield from _entries(best)

    table_rows = whole.drop("anchors")
    found = _top(table_rows.mapInArrow(same, _FOUND), positives).toArrow()
    pos: list[list] = [[] for _ in anchors.keys]
    for g, s, i, r in sorted(zip(*(found.column(c).to_pylist() for c in ("group", "score", "id", "rank")), strict=True), key=lambda x: (x[0], x[3])):
        pos[g].append((s, i))
    limits = _windows([[s for s, _ in p] for p in pos], positives, low, high)
    named = pickle.dumps((anchors, limits, pos))
    second = spark.sparkContext.broadcast(named)

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        space = pickle.loads(shared.value)
        own, limits, _ = pickle.loads(second.value)
        own.ready(space)
        best = Best(limits.shape[0] * limits.shape[1], negatives)
        for batch in batches:
            for k in range(batch.num_rows):
                _negatives(space, own, limits, Block(batch.slice(k, 1).to_pylist()[0], space), best)
        yield from _entries(best)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, pos = pickle.loads(second.value)
        for batch in batches:
            g = batch.column("group").to_numpy()
            a, x = g // positives, g % positives
            them = [pos[i][j] for i, j in zip(a.tolist(), x.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[a], mask=own.ids[a] == _NONE), pa.array([i for _, i in them], pa.int64()), batch.column("rank"), batch.column("id"), pa.array([s for s, _ in them], pa.int64()), batch.column("score")], names=[x.split()[0] for x in _OUT.split(", ")])

    return _top(table_rows.mapInArrow(other, _FOUND), negatives).mapInArrow(name, _OUT)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.when(sound, F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")))
    return hard_negatives(vectors.select(F.col("vec_id").alias("id"), label.alias("label"), scaled.alias("vector")), F.col("id") % 100 == 0)
