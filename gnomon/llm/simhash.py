"""SimHash near-de-duplication with bit-sliced comparison.

Fingerprints are compared by vertical bit planes: one machine word holds one bit
of 64 candidates, distances of all 64 are kept in carry-save counters of a few
words, and a block is abandoned once every one of its counters exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import U64, discard, documents, materialise, mix, packed, release, slices, sweep, table, utf8
from gnomon.llm.graph import components

BITS = 64
TILE = 4096  # fingerprints of one key that are compared in one task
TILE_BYTES = 32_000_000  # bytes of shingle sets of one key that are compared in one task
ROUNDS = 3  # in which keys of the first search are taken, so that a third of the sets' copies is on disk at once
LOOK = 64  # rows of a key, in order of size, that each is held against before its set is read
PAIRS = 1 << 20  # shared shingles, and cells of counts, that are held at once
_ALL = U64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased (A-Z) words, in order, with repeats; fewer words: of all of them."""
    found = text.lower().split()
    if not found:
        return np.empty(0, U64)
    line = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(start[:n].tolist(), end[min(size, len(found)) - 1 :].tolist(), strict=True)], U64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 where over half the hashes have it; 0 for no hashes."""
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp); a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            fp = [majority(shingle_hashes(data[a:b].tobytes(), shingle)) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fp, U64).view(np.int64))], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def close_lanes(fp: np.ndarray, end: np.ndarray, shift: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with i + shift < j <= i + shift + 64, j < end[i], that differ in at most ``radius`` bits."""
    at = np.flatnonzero(end > np.arange(len(fp)) + shift + 1)
    if not len(at):
        return at, at
    lanes = np.minimum(end[at] - at - shift - 1, 64).astype(U64)
    over = np.where(lanes == 64, U64(0), _ALL << np.minimum(lanes, U64(63)))  # lanes beyond the run are out from the start
    width = radius.bit_length()
    count = [np.zeros(len(at), U64) for _ in range(width)]
    word, bit = np.divmod(at + shift + 1, 64)
    bit = bit.astype(U64)
    pad = np.zeros(len(fp) // 64 * 64 + 192, np.uint8)
    for k in range(BITS):
        pad[: len(fp)] = (fp >> U64(k)).astype(np.uint8) & 1
        plane = np.packbits(pad, bitorder="little").view(U64)
        near = (plane[word] >> bit) | np.where(bit == 0, U64(0), plane[word + 1] << ((U64(64) - bit) & U64(63)))
        carry = near ^ np.where(pad[at] == 1, _ALL, U64(0))
        for c in range(width):  # carry-save: add one bit to every lane's counter
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry  # past the counter's range
        if radius + 1 != 1 << width:
            exceed = _greater(count, radius)
            over |= exceed
        if k % 8 == 7:
            live = over != _ALL
            if not live.all():  # blocks with no lane left within the radius
                at, over, word, bit, count = at[live], over[live], word[live], bit[live], [c[live] for c in count]
                if not len(at):
                    return at, at
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(hit)
    return at[i], at[i] + shift + 1 + lane


def _greater(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, by comparing from the top bit."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _ALL)
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            same &= count[c]
        else:
            more |= same & count[c]
            same &= ~count[c]
    return more


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest place reachable from each of n places over links (a, b)."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    return label


def run_ends(key: np.ndarray, tile: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    start = np.flatnonzero(new)
    return np.append(start[1:], len(key))[np.cumsum(new) - 1]


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows with a ``key`` and a ``fp``, dealt so that a key of over ``tile`` rows goes to tasks by pairs of parts.

    Adds ``part``. Each pair of rows of a key meets in at least one (key, part).
    """
    many = rows.groupBy("key").count().filter(F.col("count") > 1).select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(other, lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    return rows.join(many, "key").withColumn("own", own).withColumn("part", F.explode(pairs)).drop("own", "parts")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, cut only between groups of (key, part)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = (batch.column(c).to_numpy() for c in ("key", "part"))
        cut = batch.num_rows
        while cut and (key[cut - 1], part[cut - 1]) == (key[-1], part[-1]):
            low = max(0, cut - 1024)
            same = (key[low:cut] == key[-1]) & (part[low:cut] == part[-1])
            cut = low if same.all() else low + int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in _groups(batches):
            fp = t.column("fp").to_numpy().view(U64)
            key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
            end = run_ends(key, part, part)
            label, shift = np.arange(len(fp)), 0
            longest = int((end - np.arange(len(fp))).max())
            while shift < longest:
                label = forest(len(fp), *close_lanes(fp, end, shift, radius), label)
                shift += 64
            got = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[got].view(np.int64)), pa.array(fp[label[got]].view(np.int64))], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Distinct ``fp`` longs -> links (a, b) that connect all fingerprints within ``radius`` bits of each other.

    Of radius + 2 bit blocks at least two are equal in such a pair, so each pair of blocks keys one
    search; in a key, bit planes find the close pairs and a spanning forest of them is returned.
    """
    n = radius + 2
    cut = [round(BITS * k / n) for k in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j])))) for k, (i, j) in enumerate(combinations(range(n), 2))]
    rows = tiled(fps.select("fp", F.explode(F.array(*keys)).alias("key")), tile)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp").mapInArrow(_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint every text and group the fingerprints linked at ``radius`` or fewer differing bits.

    Words are runs without white space after A-Z are lower-cased; a fingerprint bit is 1 if set in
    over half of the XXH64 values (seed 42) of the word shingles, repeats included; fewer words than
    a shingle: of the whole sequence.

    Output: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable). Null
    and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node,
    so groups of copies cost nothing more. Repeated doc_ids give a row each; a null doc_id is kept
    and is nobody's component unless all of its group are null. An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(fingerprint_links(nodes.select("fp"), radius))
    roots = materialise(found)
    discard(found.table)
    held = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = held.groupBy("root").agg(F.min("low").alias("component_id"))
    each = held.join(lowest, "root").select("fp", "component_id")
    return marked.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates by shingle similarity: the same comparison, then an exact check ----


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of that similarity, the smallest common element is among so many smallest of each."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def parity(h: np.ndarray) -> bytes:
    """Bits of how many hashes, odd or even, fall on each; at least as many bits as hashes. Two differ in no more bits than the sets in elements."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    return packed(np.packbits(np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little"))


def _sketches(shingle: int, keys: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            fp, low, sets, ident, tail, odd = [], [], [], [], [], []
            for a, b in zip(offsets, offsets[1:], strict=False):
                h = np.unique(mix(shingle_hashes(data[a:b].tobytes(), shingle)))
                fp.append(majority(h))
                low.append(h[:keys].view(np.int64))
                tail.append(packed(h[: prefix_length(len(h), similarity)].astype(np.uint32)))  # with the first of the set these are whole again
                odd.append(parity(h))
                sets.append(packed((h >> U64(32)).astype(np.uint32)))
                ident.append(xxhash.xxh3_128_digest(packed(h)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(ident, pa.binary()), pa.array(np.array(fp, U64).view(np.int64)), _lists(low), pa.array(tail, pa.binary()), pa.array(odd, pa.binary()), pa.array(sets, pa.binary())],
                names=["doc_id", "text_key", "ident", "fp", "low", "tail", "odd", "grams"],
            )

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, grams, tail) -> (node, bytes, first): the smallest hashes of a set, all 64 bits of them."""
    release()
    for batch in batches:
        high, low = utf8(batch.column("grams")), utf8(batch.column("tail"))
        first = []
        for a, c, d in zip(high[1][:-1], low[1], low[1][1:], strict=False):
            some = high[0][a : a + d - c].view(np.uint32).astype(U64) << U64(32)
            first.append((some | low[0][c:d].view(np.uint32).astype(U64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(high[1]).astype(np.int32)), _lists(first)], names=["node", "bytes", "first"])


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def _similar(radius: int, similarity: float):
    """Groups of rows sharing a key: fingerprints within the radius, then the exact similarity of the shingle sets.

    ``lab`` names what is known to be connected; links between such names are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in _groups(batches):
            fp, lab = t.column("fp").to_numpy().view(U64), t.column("lab").to_numpy()
            part = t.column("part").to_numpy()
            end = run_ends(t.column("key").to_numpy(), part, part)
            data, offsets, _ = utf8(t.column("grams"))
            _, first, which = np.unique(lab, return_index=True, return_inverse=True)
            label, shift = first[which], 0
            longest = int((end - np.arange(len(fp))).max())
            size = np.diff(offsets) // 4
            while shift < longest:
                a, b = close_lanes(fp, end, shift, radius)
                shift += 64
                fit = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
                a, b = a[fit], b[fit]
                cut = np.flatnonzero(np.diff(a, prepend=-1))
                for s, e in zip(cut, np.append(cut[1:], len(a)) if len(cut) else cut, strict=True):
                    i, js = a[s], b[s:e]
                    js = js[label[js] != label[i]]  # what is connected already needs no check
                    if not len(js):
                        continue
                    mine = data[offsets[i] : offsets[i + 1]].view(np.uint32)
                    sets = [data[offsets[j] : offsets[j + 1]].view(np.uint32) for j in js]
                    other = np.concatenate(sets)
                    place = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                    both = np.add.reduceat((mine[place] == other).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]))
                    ok = both >= similarity * (len(mine) + size[js] - both) - 1e-9
                    if ok.any():
                        label = forest(len(fp), np.full(int(ok.sum()), i), js[ok], label)
            got = np.flatnonzero(lab[label] != lab)
            yield pa.RecordBatch.from_arrays([pa.array(lab[got]), pa.array(lab[label[got]])], names=["a", "b"])

    return run


def overlaps(sets: np.ndarray, size: np.ndarray, group: np.ndarray, lab: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common elements) of all rows i < j of one group and of different ``lab`` that have a common element.

    ``sets`` holds the rows' sets one after the other; rows are in order of (group, lab). Only elements
    that two labs of a group share cost more than a sort.
    """
    new = np.diff(group, prepend=-1) != 0
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    code = sets.astype(U64) | (np.cumsum(new)[owner].astype(U64) << U64(32))
    order = np.argsort(code, kind="stable")
    code, own = code[order], owner[order]
    other = run_ends(code, lab[own], code)  # from here on, rows of other labs have the element
    reach = run_ends(code, code, code) - other
    live = np.flatnonzero(reach)
    live = live[np.argsort(own[live], kind="stable")]
    mine, other, reach = own[live], other[live], reach[live]
    cells = np.concatenate([[0], np.cumsum(width)])
    done = np.concatenate([[0], np.cumsum(reach)])
    for a, b in slices(cells, PAIRS):
        lo, hi = np.searchsorted(mine, [a, b])
        if lo == hi:
            continue
        count = np.zeros(cells[b] - cells[a], np.int32)
        for s, e in slices(done[lo : hi + 1], PAIRS):
            s, e = lo + s, lo + e
            j = own[np.repeat(other[s:e] - done[s:e], reach[s:e]) + np.arange(done[s], done[e])]
            i = np.repeat(mine[s:e], reach[s:e])
            count += np.bincount(cells[i] - cells[a] + j - start[i], minlength=len(count)).astype(np.int32)
        at = np.flatnonzero(count)
        i = np.searchsorted(cells, at + cells[a], "right") - 1
        yield i, at + cells[a] - cells[i] + start[i], count[at]


def hopeful(key: np.ndarray, lab: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows may be similar to one of another ``lab`` that has the key as their first in common; in order of (key, n).

    Sizes must fit, and what either set has from its ``place`` on must be enough. Rows are kept where not
    all of their key is at hand, or more than LOOK of it would have to be looked at.
    """
    at = np.arange(len(key))
    end = run_ends(key, key, key)
    keep = (key == key[0]) | (end == len(key)) if len(key) else np.zeros(0, bool)
    left, d = n - place, 1
    at = at[end > at + 1]
    while len(at):
        fits = n[at] >= similarity * n[at + d] - 2  # those after it are larger still
        at = at[fits]
        j = at + d
        if d > LOOK:
            more = np.zeros(len(key) + 1, np.int64)
            np.add.at(more, j, 1)
            np.add.at(more, end[at], -1)
            keep |= np.cumsum(more[:-1]) > 0
            keep[at] = True
            break
        ok = (lab[at] != lab[j]) & (np.minimum(left[at], left[j]) >= similarity / (1 + similarity) * (n[at] + n[j]) - 2)
        keep[at[ok]] = keep[j[ok]] = True
        d += 1
        at = at[end[at] > at + d]
    return keep


def _hopeful(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            key, lab, size, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lab", "bytes", "pos"))
            keep = hopeful(key, lab, size // 4, place, similarity)
            yield batch.select(["key", "node", "lab", "bytes"]).filter(pa.array(keep))

    return run


def alike(group_end: np.ndarray, lab: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows may be similar to one of their group of another ``lab``, by their parities; in order of (group, n)."""
    flat, word = data[offsets[0] : offsets[-1]].view(U64), np.diff(offsets) // 8
    off = (offsets[:-1] - offsets[0]) // 8
    keep = np.zeros(len(lab), bool)

    def folded(x: np.ndarray, u: int) -> np.ndarray:
        out = np.zeros((len(x), u), U64)
        for r in range(int(word[x].max()) // u):
            m = word[x] > r * u
            out[m] ^= flat[(off[x[m]] + r * u)[:, None] + np.arange(u)]
        return out

    at, d = np.flatnonzero(group_end > np.arange(len(lab)) + 1), 1
    while len(at):
        at = at[n[at] >= similarity * n[at + d] - 2]  # those after it are larger still
        a = at[(lab[at] != lab[at + d]) & ~(keep[at] & keep[at + d])]
        width = np.minimum(word[a], word[a + d])
        for u in np.unique(width).tolist():
            those = a[width == u]
            for s in range(0, len(those), max(1, PAIRS // u)):
                x = those[s : s + max(1, PAIRS // u)]
                apart = np.bitwise_count(folded(x, u) ^ folded(x + d, u)).sum(1, dtype=np.int64)
                ok = apart <= (n[x] + n[x + d]) * (1 - similarity) / (1 + similarity) + 2
                keep[x[ok]] = keep[x[ok] + d] = True
        d += 1
        at = at[group_end[at] > at + d]
    return keep


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in _groups(batches):
            part = t.column("part").to_numpy()
            end = run_ends(t.column("key").to_numpy(), part, part)
            keep = alike(end, t.column("lab").to_numpy(), t.column("bytes").to_numpy().astype(np.int64) // 4, *utf8(t.column("odd"))[:2], similarity)
            yield from t.select(["key", "part", "node", "lab"]).filter(pa.array(keep)).to_batches()

    return run


def _exact(similarity: float):
    """Links of all rows of a group that are similar and of different ``lab``, by counts of what their sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for t in _groups(batches):
            lab, part = t.column("lab").to_numpy(), t.column("part").to_numpy()
            end = run_ends(t.column("key").to_numpy(), part, part)
            data, offsets, _ = utf8(t.column("grams"))
            _, first, which = np.unique(lab, return_index=True, return_inverse=True)
            label, size = first[which], np.diff(offsets) // 4
            bounds = np.concatenate([[0], np.unique(end)])
            for s, e in slices(offsets[bounds], 4 * PAIRS):
                s, e = bounds[s], bounds[e]
                for i, j, both in overlaps(data[offsets[s] : offsets[e]].view(np.uint32), size[s:e], end[s:e], lab[s:e]):
                    i, j = i + s, j + s
                    ok = both >= similarity * (size[i] + size[j] - both) - 1e-9
                    if ok.any():
                        label = forest(len(label), i[ok], j[ok], label)
            got = np.flatnonzero(lab[label] != lab)
            yield pa.RecordBatch.from_arrays([pa.array(lab[got]), pa.array(lab[label[got]])], names=["a", "b"])

    return run


def _parts(rows: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Adds ``parts``: into how many a key's rows are dealt, so that one has about ``tile`` rows and ``tile_bytes`` of sets."""
    count = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("held")).filter("n > 1")
    return rows.join(count.select("key", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("held") / tile_bytes)).cast("int").alias("parts")), "key")


def across(rows: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Rows (key, node, lab, ...) dealt so that rows of a key with different ``lab`` meet in at least one (key, part).

    A lab with much of a key is dealt into parts of its own, which never meet each other; the other
    labs share bins. A group that is connected already so costs a copy of its rows for each bin of
    other rows beside it, not the square of its size. Keys of one lab are left out.
    """
    each = rows.groupBy("key", "lab").agg(F.count("*").alias("n"), F.sum("bytes").alias("held"))
    each = each.withColumn("size", F.greatest(F.col("n") / tile, F.col("held") / tile_bytes)).withColumn("own", F.ceil("size").cast("int"))
    large = F.col("size") > 0.5
    # at most two entries of ``large`` for each part of a key
    many = each.groupBy("key").agg(F.count("*").alias("labs"), F.ceil(F.sum(F.when(~large, F.col("size")).otherwise(0.0))).cast("int").alias("bins"), F.collect_list(F.when(large, F.struct("lab", "own"))).alias("large")).filter("labs > 1")
    here = rows.join(many, "key").withColumn("mine", F.get(F.filter("large", lambda x: x["lab"] == F.col("lab")), F.lit(0))["own"])
    name = lambda big, lab, k: F.struct(big.alias("big"), lab.alias("lab"), k.cast("int").alias("k"))
    none, no = F.lit(0).cast("long"), F.lit(False)
    bins = F.when(F.col("bins") > 0, F.transform(F.sequence(F.lit(0), F.greatest("bins", F.lit(1)) - 1), lambda k: name(no, none, k))).otherwise(F.array().cast("array<struct<big:boolean,lab:bigint,k:int>>"))
    parts = F.flatten(F.transform(F.filter("large", lambda x: x["lab"] != F.col("lab")), lambda x: F.transform(F.sequence(F.lit(0), x["own"] - 1), lambda k: name(F.lit(True), x["lab"], k))))
    me = F.when(F.col("mine").isNotNull(), name(F.lit(True), F.col("lab"), F.pmod(F.xxhash64("node", F.lit(9)), F.col("mine")))).otherwise(name(no, none, F.pmod(F.xxhash64("lab", F.lit(9)), F.greatest("bins", F.lit(1)))))
    met = here.withColumn("me", me).withColumn("other", F.explode(F.concat(bins, parts)))
    low, high = F.least("me", "other"), F.greatest("me", "other")
    return met.withColumn("part", F.xxhash64(low, high)).drop("labs", "bins", "large", "mine", "me", "other")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, keys: int = 5, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more, and chains of such.

    Equal sets are one node. A first search finds most links at low cost: each document is keyed by
    its ``keys`` smallest shingle hashes; in a key, fingerprints are compared in bit planes at
    ``radius`` and what passes is checked on the whole shingle sets. A key of many rows or bytes is
    dealt into parts, each searched alone; one row of each group found in a part is searched again
    with those of other parts, as long as that leaves far fewer rows. The second search is exact and
    uses no fingerprint: documents are keyed by so many smallest hashes (a fifth of the set and one, at
    0.8) that any similar pair shares one, and in each key all rows that are in different groups still,
    and that sizes, places of the key and parities of the sets do not rule out for certain, are compared by their whole sets. Nothing is dropped. Sets hold 32 bits of each shingle's 64-bit
    hash, with repeats: shingles whose 32 bits are equal never lower a count of common shingles, so no link is
    lost; a pair just below the similarity can pass if one text holds two such shingles (of texts of 10,000
    shingles one in 90 does) and the other one of them.

    Output: doc_id, text_key (a hash of the text: a row is told by both), component_id (the group's
    smallest doc_id) and kept, true for one document of each group, that of the smallest doc_id (and
    text_key, where rows with different texts share it). Texts without words form no group, nor do
    rows with a null doc_id: each is its own and is kept. Null texts count as empty, repeated doc_ids
    keep a row each.
    """
    source = documents(docs).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, ident binary, fp long, low array<long>, tail binary, odd binary, grams binary"
    # rows are numbered as they are written; a set of shingles is a node, told by the first of its rows, whatever doc_ids these have
    marked = materialise(source.mapInArrow(_sketches(shingle, keys, similarity), schema).withColumn("row", F.monotonically_increasing_id()), clear=True)
    some = F.min(F.struct("row", "fp", "low", F.octet_length("grams").alias("bytes"))).alias("x")  # all but row are equal
    nodes = marked.filter("size(low) > 0 and doc_id is not null").groupBy("ident").agg(some, F.min(F.struct("doc_id", "text_key")).alias("best"))
    nodes = nodes.select("ident", "best", F.col("x.row").alias("node"), "x.fp", "x.low", "x.bytes")
    nodes = materialise(nodes, clear=True)
    keyed = nodes.select("node", "fp", "bytes", F.col("node").alias("lab"), F.explode("low").alias("key"))
    dealt = materialise(_parts(keyed, tile, tile_bytes).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))), clear=True)
    sets = marked.select(F.col("row").alias("node"), "grams")

    def search(rows: DataFrame) -> DataFrame:
        whole = rows.select("key", "part", "fp", "node", "lab").join(sets, "node")
        return materialise(whole.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp", "lab", "grams").mapInArrow(_similar(radius, similarity), "a long, b long"), clear=True)

    spark = docs.sparkSession
    sweep(spark)
    written = []
    for turn in range(ROUNDS):
        written.append(search(dealt.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(ROUNDS)) == turn)))
        sweep(spark)
    links = written[0]
    for more in written[1:]:
        links = links.union(more)
    roots = components(links)
    hot = dealt.filter("parts > 1").drop("part", "parts")
    n = hot.count()
    while n:
        now = named(hot, roots)
        heads = now.groupBy("key", "lab").agg(F.min(F.struct("node", "fp", "bytes")).alias("x")).select("key", "lab", "x.*")
        before, n = n, heads.count()
        if 2 * n > before:
            break
        again = materialise(_parts(heads, tile, tile_bytes).withColumn("part", F.pmod(F.xxhash64("node", F.lit(8)), F.col("parts"))), clear=True)
        written.append(search(again))
        links, old = links.union(written[-1]), roots
        roots = components(links)
        last = again.filter("parts > 1").isEmpty()
        discard(again, old.table)
        if last:
            break
    discard(dealt)
    labs = named(nodes.select("node"), roots)
    ahead = marked.select("row", "grams", "tail").mapInArrow(_first, "node long, bytes int, first array<long>").join(labs, "node")
    ahead = ahead.select("node", "lab", "bytes", F.posexplode("first").alias("pos", "key"))
    shared = materialise(ahead.repartition("key").sortWithinPartitions("key", "bytes").mapInArrow(_hopeful(similarity), "key long, node long, lab long, bytes int"), clear=True)
    sweep(spark)
    odd = marked.select(F.col("row").alias("node"), "odd")
    near = across(shared, tile, tile_bytes // 4).select("key", "part", "node", "lab", "bytes").join(odd, "node")
    near = near.repartition("key", "part").sortWithinPartitions("key", "part", "bytes").select("key", "part", "node", "lab", "bytes", "odd")
    close = materialise(near.mapInArrow(_alike(similarity), "key long, part long, node long, lab long"), clear=True)
    discard(shared)
    sweep(spark)
    met = close.join(sets, "node").repartition("key", "part").sortWithinPartitions("key", "part", "lab").select("key", "part", "lab", "grams")
    written.append(materialise(met.mapInArrow(_exact(similarity), "a long, b long"), clear=True))
    discard(close, roots.table)
    sweep(spark)
    roots = components(links.union(written[-1]))
    held = nodes.join(roots, "node", "left").select("ident", "best", F.coalesce("root", "node").alias("root"))
    best = held.groupBy("root").agg(F.min("best").alias("first"))
    group = held.join(best, "root").select("ident", "first")
    grouped = F.col("first").isNotNull() & F.col("doc_id").isNotNull()
    out = marked.select("doc_id", "text_key", "ident").join(group, "ident", "left").select("doc_id", "text_key", F.when(grouped, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), (~grouped | (F.struct("doc_id", "text_key") == F.col("first"))).alias("kept"))
    out = materialise(out, clear=True)
    discard(marked, nodes, roots.table, *written)
    return out


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with ``lab`` as the smallest node that theirs is known to be connected to."""
    return rows.drop("lab").join(roots, "node", "left").withColumn("lab", F.coalesce("root", "node")).drop("root")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
