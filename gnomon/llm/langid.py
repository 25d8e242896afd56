"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages' filters lie in one table: a slot holds a bit for each language, so
one look-up per hash returns the set of languages that contain an n-gram. A text's
n-grams are looked up, hits are counted per language, corrected for the filters'
false positives, and the language with most of them is chosen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import U64, discard, documents, materialise, mix, powers, release, table, utf8

GRAM = 4  # letters and word bounds in an n-gram
SLOTS = 1 << 20  # slots of a table, of 8 bytes at most, at least; there is a table for each 64 languages
FILL = 16  # slots for each n-gram of the language that has most
HASHES = 2
ROWS = 3000  # documents a language, at most in expectation, that filters are fitted on

_LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])


def grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of the texts, how many each text has).

    Letters are lower-cased and each run of other characters is one bound; every text begins and
    ends with a bound.
    """
    joined = np.frombuffer("\x00".join(["", *(t.lower().replace("\x00", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(joined < 1 << 16, _LETTER[np.minimum(joined, (1 << 16) - 1)], True)
    code = np.where(letter, joined, 0)
    last = joined == 0
    keep = letter | last
    keep[1:] |= letter[:-1]
    # a bound right before a text's end is that text's end
    keep[:-1] &= ~(~letter[:-1] & ~last[:-1] & last[1:])
    code, last = code[keep], last[keep]
    edge = np.flatnonzero(last)
    size = np.diff(edge) + 1 - n + 1  # with both bounds
    # the bound between two texts belongs to both: windows over it are cut out below
    h = np.zeros(max(0, len(code) - n + 1), U64)
    for k in range(n):
        h += (code[k : len(h) + k].astype(U64) + U64(1)) * powers(0x9E3779B97F4A7C15, n)[k]
    ok = np.ones(len(h), bool)
    for k in range(1, n - 1):
        ok &= ~last[k : len(h) + k]
    return mix(h[ok]), np.maximum(size, 0)


def slots(h: np.ndarray, k: int, size: int = SLOTS) -> np.ndarray:
    """Places of the k-th hash in a table of ``size`` slots, a power of two."""
    return (h >> U64(max(21, size.bit_length() - 1) * k)).astype(np.int64) & (size - 1)


def room(grams: int) -> int:
    """Slots of a table for filters of so many n-grams: their share of ones stays below an eighth."""
    return max(SLOTS, 1 << (FILL * max(1, grams) - 1).bit_length())


class Filters:
    """languages, the bit-sliced tables (one for each 64 languages) and each filter's chance of a false positive."""

    def __init__(self, languages: list[str], size: int, places: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """``places``: number of the table, slot and set of languages, each slot once."""
        self.languages, self.size = languages, size
        width = min(64, len(languages))
        self.kind = next(t for t in (np.uint8, np.uint16, np.uint32, U64) if width <= 8 * np.dtype(t).itemsize)
        self.tables = [np.zeros(size, self.kind) for _ in range(0, len(languages), 64)]
        part, slot, mask = places
        for k, t in enumerate(self.tables):
            t[slot[part == k]] = mask[part == k].astype(self.kind)
        self.chance = np.array([self._bit(self.tables[bit // 64], bit).mean() ** HASHES for bit in range(len(languages))])

    def _bit(self, sets: np.ndarray, bit: int) -> np.ndarray:
        return (sets >> self.kind(bit % 64)) & self.kind(1)

    def hits(self, h: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The set of a table's languages, as bits, that may contain each n-gram."""
        out = table[slots(h, 0, self.size)]
        for k in range(1, HASHES):
            out &= table[slots(h, k, self.size)]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) hits corrected for false positives, and the number of n-grams of each text."""
        h, size = grams(texts)
        edge = np.concatenate([[0], np.cumsum(size)])
        out = np.empty((len(texts), len(self.languages)))
        for bit in range(len(self.languages)):
            if bit % 64 == 0:
                sets = self.hits(h, self.tables[bit // 64])
            total = np.concatenate([[0], np.cumsum(self._bit(sets, bit), dtype=np.int64)])
            out[:, bit] = total[edge[1:]] - total[edge[:-1]]
        return np.maximum(0, out - size[:, None] * self.chance) / (1 - self.chance), size


def fold(df: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text is divisible by 5 (a null doc_id is not held out)."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def train(docs: DataFrame, rows: int = ROWS) -> Filters:
    """Fit filters on a sample of about ``rows`` training documents a language, chosen by a hash of doc_id.

    Only text and non-null lang of documents that are not held out are used. A filter takes in every n-gram of its
    language's sample, and tables have room for the language with most; only the tables' slots come to the driver.
    """
    learn = fold(documents(docs, "lang")).filter("not held_out and lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not n:
        return Filters(["und"], SLOTS, (np.empty(0, np.int64),) * 3)
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, rows / v)))])
    picked = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            text = batch.column("text").to_pylist()
            for name in sorted(set(lang)):
                h = np.unique(grams([t for t, x in zip(text, lang, strict=True) if x == name])[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["lang", "h"])

    found = materialise(picked.mapInArrow(each, "lang string, h long").distinct())
    size = room(max((r["count"] for r in found.groupBy("lang").count().collect()), default=0))
    languages = sorted(n)
    number = F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))])[F.col("lang")]
    shift = max(21, size.bit_length() - 1)
    slot = F.explode(F.array(*(F.shiftrightunsigned("h", shift * k).bitwiseAND(F.lit(size - 1)) for k in range(HASHES))))
    bit = found.withColumn("number", number).select((F.col("number") / 64).cast("int").cast("long").alias("part"), F.expr("shiftleft(1L, number % 64)").alias("mask"), slot.alias("slot"))
    got = bit.groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a slot at most
    discard(found)
    return Filters(languages, size, tuple(got.column(c).to_numpy() for c in ("part", "slot", "mask")))


def identify(docs: DataFrame, filters: Filters, *keep: str) -> DataFrame:
    """Language of every whole text.

    Output: doc_id, lang_pred, score, known, n_grams and the columns in ``keep``. ``lang_pred`` is a learned
    language, or 'und' if the text is null or has no letter; ``score`` is that language's share of
    all corrected hits (0 for 'und'); ``known`` is the share of the text's ``n_grams`` n-grams in its filter (0 of none).
    Ties go to the first language in order of name. Repeated and null doc_ids keep a row each, an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(filters))  # of the size of its tables: 8 bytes a slot at most for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = pickle.loads(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            pred, score, known, n_grams, s = [], [], [], [], 0
            while s < len(texts):
                e, held = s, 0
                while e < len(texts) and (e == s or held + len(texts[e]) < 1_000_000):
                    held += len(texts[e])
                    e += 1
                part = texts[s:e]
                c, size = model.counts(part)
                best, total = c.argmax(1), c.sum(1)
                n_grams.extend(size.tolist())
                has = [any(map(str.isalpha, t)) for t in part]
                for k in range(len(part)):
                    pred.append(model.languages[best[k]] if has[k] else "und")
                    score.append(float(c[k, best[k]] / total[k]) if has[k] and total[k] > 0 else (1.0 / len(model.languages) if has[k] else 0.0))
                    known.append(float(min(1.0, c[k, best[k]] / size[k])) if size[k] > 0 else 0.0)
                s = e
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "known": pa.array(known, pa.float64()), "n_grams": pa.array(n_grams, pa.int64())}
            yield pa.RecordBatch.from_arrays([*out.values(), *(batch.column(x) for x in keep)], names=[*out, *keep])

    source = documents(docs, *(x for x in keep if x != "text"))
    kinds = ", ".join(f"`{x}` {source.schema[x].dataType.simpleString()}" for x in keep)
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, known double, n_grams long" + (", " + kinds if keep else ""))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fold(identify(docs, train(docs))).select("doc_id", "held_out", "lang_pred", "score")
