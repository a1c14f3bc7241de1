"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._util import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) for every node u of links (a, b) but the smallest of its component, with that smallest node as v.

    Each round is two aggregations by node, combined before their shuffle, and joins with their unique results, so a hub
    may have any number of links.  Rounds go on until nothing changes; they grow with the logarithm of the longest path.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        tied = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges
