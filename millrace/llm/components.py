"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import remove, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all ends of ``edges`` (columns ``a``, ``b``).

    Each round links every node to the smallest one it knows, first its larger,
    then its smaller neighbours, so that chains shrink to stars in a number of
    rounds that grows with the logarithm of their length. A node's neighbours
    are never gathered: their minimum is added up by partial aggregation and
    joined back, where adaptive execution splits hot nodes.
    """
    spark, kept, older = edges.sparkSession, [], []
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), older)
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stored(larger.where("u <> v").distinct(), older)
        # Every link now leads from a larger to a smaller node.
        lowest = star.groupBy("u").agg(F.min("v").alias("m"))
        moved = star.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = lowest.select("u", F.col("m").alias("v"))
        links = stored(moved.unionAll(own).where("u <> v").distinct(), kept)
        remove(spark, older)
        older, kept = kept, []
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
