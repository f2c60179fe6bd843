"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import discard, staged


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node reachable, for every node that has an edge.

    Each round hangs neighbours on smaller ones, halving what is left of long chains; a hub's edges are
    minimised before the shuffle and its join is one that Spark can split. Every round is written to the
    shared folder; what the driver sees of it is a count and a sum of hashes."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = staged(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct(), name)
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
        then = staged(small.filter("a <> b").distinct(), name)
        discard(now)
        now = then
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
