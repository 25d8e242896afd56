"""Compression classifier: zstandard dictionaries trained on good and on bad labelled text.

A text is compressed with the dictionaries of either class; it is like the class whose
dictionary makes it smaller. The difference of the two sizes, normalised by the text's
size, is calibrated to a probability by logistic regression. There are three pairs of
dictionaries, short and long ones, and so three differences; nothing else enters a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gnomon.llm.common import documents, table, utf8
from gnomon.llm.langid import fold

ROWS = 3000  # labelled documents a class, in expectation, that dictionaries and calibration see
SAMPLE_BYTES = 24_000_000  # of texts of a class that dictionaries are trained on: rows beyond it are not sampled
DICTIONARIES = ((32_768, 200, 6), (65_536, 50, 8), (110_000, 1000, 8))  # of each pair: bytes, and the segments and grams that are looked for
LEVEL = 3


class Model:
    """Pairs (good, bad) of dictionaries and the calibration of their differences."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.pairs, self.weights, self.scale = pairs, weights, scale

    def compressors(self):
        """Of each pair the good one, then the bad one."""
        made = [zstandard.ZstdCompressionDict(d) if d else None for pair in self.pairs for d in pair]
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in made]

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        """(bytes, sizes with good and bad of each pair) -> each pair's difference, normalised by size, by its root and by the larger, and with the logarithm of size."""
        n = sizes[:, :1].astype(float)
        g, b = sizes[:, 1::2].astype(float), sizes[:, 2::2].astype(float)
        diff = (b - g) / (n + 16)
        return np.hstack([diff, diff * np.log1p(n), (b - g) / np.sqrt(n + 16), (b - g) / np.maximum(1, np.maximum(g, b))])

    def score(self, sizes: np.ndarray) -> np.ndarray:
        mean, spread = self.scale
        z = (self.features(sizes) - mean) / spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))

    def calibrate(self, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Fit to weighted labels."""
        x = self.features(sizes)
        mean, spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
        w = np.zeros(z.shape[1])
        weight = weight / max(weight.mean(), 1e-9) if len(weight) else weight
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (weight * (label - p)) - w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.scale = w, np.array([mean, spread])


def _sizes(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = pickle.loads(model).compressors()
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            view = memoryview(data)
            got = [[b - a, *(len(c.compress(view[a:b])) for c in tools)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = np.array(got, np.int64).reshape(-1, 1 + len(tools))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(sizes.ravel()), sizes.shape[1]).cast(pa.list_(pa.int64()))], names=["doc_id", "sizes"])

    return run


_SIZES = "doc_id long, sizes array<long>"


def dictionary(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A dictionary trained on the samples, each once; of too few samples to train on, the end of their bytes."""
    samples = list(dict.fromkeys(samples))
    while size >= 1024 and len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
        except zstandard.ZstdError:  # more than these samples can fill
            size //= 2
    return b"".join(samples)[-4096:]


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES, prior: float | None = None) -> Model:
    """Fit on about ``rows`` labelled documents of each class that are not held out, chosen by a hash of doc_id.

    One half trains the dictionaries, on whole texts, as many rows as ``sample_bytes`` hold (a longer text is no row of the
    sample); the other calibrates, weighted so that a score is the chance of label 1 where ``prior`` of
    all texts have it: by default half-way, in logarithms of odds, between equal classes and the labels, so that
    the rarer class is not drowned by the other. Labels with a null quality are not used; of several labels of one document, the lowest is.
    """
    known = fold(labels.select("doc_id", "quality")).filter("not held_out and quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if prior is None:
        odds = ((count.get(1, 0) + 1) / (count.get(0, 0) + 1)) ** 0.5
        prior = odds / (1 + odds)
    share = F.when(F.col("quality") == 1, min(1.0, rows / max(1, count.get(1, 0)))).otherwise(min(1.0, rows / max(1, count.get(0, 0))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / (1 << 20)
    known = known.withColumn("chance", chance / share).filter("chance < 1").select("doc_id", "quality", "chance")
    picked = documents(docs).filter("text is not null").join(F.broadcast(known), "doc_id")  # about 2 * rows rows
    size = F.octet_length("text")
    held = F.sum(size).over(Window.partitionBy("quality").orderBy("chance", "doc_id", F.xxhash64("text")))
    first = picked.filter("chance < 0.5").filter(size <= sample_bytes).withColumn("held", held).filter(F.col("held") <= sample_bytes).select("quality", "text").toArrow()
    told = list(zip(first.column("quality").to_pylist(), first.column("text").to_pylist(), strict=True))
    texts = [[t.encode() for q, t in told if (q == 1) == good and t] for good in (True, False)]
    model = Model([tuple(dictionary(x, *shape) for x in texts) for shape in DICTIONARIES])
    second = picked.filter("chance >= 0.5").select("doc_id", "text").mapInArrow(_sizes(pickle.dumps(model)), _SIZES).join(F.broadcast(known), "doc_id").orderBy("doc_id").toPandas()
    label = (second["quality"] == 1).to_numpy(float)
    weight = np.where(label == 1, prior / max(1.0, label.sum()), (1 - prior) / max(1.0, (1 - label).sum()))
    model.calibrate(np.array(second["sizes"].tolist(), np.int64).reshape(len(second), 1 + 2 * len(model.pairs)), label, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 likelier) of every whole text.

    Null texts score as empty ones, which have the score of the calibration at size 0. Repeated and
    null doc_ids keep a row each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # six dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in _sizes(shared.value)(batches):
            sizes = batch.column("sizes").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.score(sizes) if len(sizes) else np.empty(0))], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return fold(scored).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
