"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
No stage can be put in SQL as a whole (languages are learned, near-duplicates and
packing have no SQL form), so ORACLE_SQL is None and tests hold stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm.common import discard, materialise, prepare, table
from gnomon.llm.decontam import contamination
from gnomon.llm.langid import identify, train
from gnomon.llm.packing import pack
from gnomon.llm.simhash import near_duplicates
from gnomon.llm.substring import substring_dedup

KNOWN = 0.2  # least share of a text's n-grams that its language must know
ENOUGH = 32  # n-grams that a text needs for that share to mean something: one or two unseen words have fewer


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(docs with every column but doc_id, text and n_chars called by number, so that none clashes; their names)"""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars", "lang") else f"c{k}" for k, c in enumerate(docs.columns))), docs.columns


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: no letter at all, or too few n-grams that any language knows.

    Texts of fewer than ENOUGH n-grams stay if they have a letter. Null texts go; every other column is passed on as it is.
    """
    prepare(spark)
    plain, names = numbered(docs)
    keep = [c for c in plain.columns if c != "doc_id"]
    kept = identify(plain, train(plain), *keep).filter(f"lang_pred <> 'und' and (known >= {KNOWN} or n_grams < {ENOUGH})")
    return kept.select(*plain.columns).toDF(*names)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near-duplicates (five words, 0.8).

    Rows are told by doc_id and text: of rows that are alike in both, one stays.
    """
    prepare(spark)
    plain, names = numbered(docs)
    found = near_duplicates(docs).withColumnRenamed("doc_id", "found_id")
    keyed = plain.withColumn("found_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("found_key") == F.col("text_key"))
    kept = keyed.join(found.filter("not kept").select("found_id", "text_key").distinct(), same, "left_anti")
    twice = found.groupBy("found_id", "text_key").count().filter("count > 1").select("found_id", "text_key")
    if not twice.isEmpty():
        once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "found_key"])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.select(*plain.columns).toDF(*names)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 13 or more words that also start in an earlier document; what is emptied goes.

    Of rows with one doc_id, whose passages count as one document's, each keeps its own other columns.
    """
    prepare(spark)
    plain, names = numbered(docs)
    kept = substring_dedup(plain, with_text=True).filter("n_removed = 0 or n_removed < n_words").select("kept", F.col("doc_id").alias("found_id"), "text_key")
    keyed = plain.withColumn("found_key", F.xxhash64(F.col("text").cast("string"))).drop("text")
    if not keyed.groupBy("doc_id", "found_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["found_id", "text_key"])
    joined = kept.join(keyed, F.col("found_id").eqNullSafe(F.col("doc_id")) & (F.col("found_key") == F.col("text_key")))
    return joined.select(*(F.col("kept").alias("text") if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in plain.columns)).toDF(*names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark.

    Documents are told by doc_id: rows that share one go together, those without one cannot be told apart and stay.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialise(found.filter("contaminated").select("doc_id").distinct())
    discard(found.index)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 token ids."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicate),
    ("substring dedup", substring),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            if k:
                discard(before)
    return docs
