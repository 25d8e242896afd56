"""Connected components of links, by alternating stars over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, root): root is the smallest id that node can reach.

    Only nodes of some link between different ids are returned. Every round joins links with
    smallest neighbours, so a hub's links are never gathered in one row or task (skewed joins are
    split by the engine); each round's links are written to the shared folder, where ``table`` of the
    result is the last. Rounds grow with the logarithm of the longest path.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        # large star: each node's larger neighbours go to its smallest neighbour (or itself)
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each node's smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        before, links = links, materialise(small)
        discard(before)
        sums = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == sums or not sums["n"]:
            break
        seen = sums
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out.table = links
    return out
