"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sized, written


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node and component (its least reachable node) of every node that has an edge.

    Alternating stars: each round links every node to the least node around it, first from
    its larger neighbours, then from its smaller ones, until nothing changes. Rounds grow
    with the logarithm of a component's size, not with its diameter. All steps are joins
    on a node and minima with map-side combining, so a hub's rows can be split. The tasks
    of a round grow with its edges, and what one holds does not. Each round is written,
    which cuts the lineage. Null ends and self links are ignored, except
    that a self link makes its node known.
    """
    spark = edges.sparkSession
    known = edges.select(F.col(a).alias("hi"), F.col(b).alias("lo")).filter("hi IS NOT NULL AND lo IS NOT NULL")
    with sized(spark, known.count()):
        pairs = written(known.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    alone = pairs.filter("hi = lo").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    pairs, seen = pairs.filter("hi <> lo"), None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        with sized(spark, 2 * mark[0]):
            # Written, so that the joins read both sides from shuffles, of which a hub's part can be split.
            least = written(both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least")), "least")
            large = both.filter("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
            large = written(large.distinct(), "large")
            lowest = written(large.groupBy("hi").agg(F.min("lo").alias("low")), "lowest")
            small = large.join(lowest, "hi").filter("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
            pairs = written(small.unionByName(lowest.withColumnRenamed("low", "lo")).distinct(), "edges")
    found = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    with sized(spark, 2 * (seen[0] if seen else 0)):
        return written(found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component")), "components")
