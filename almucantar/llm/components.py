"""Connected components of links, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``edges`` (a long, b long) to (node, component), the smallest node reachable; nodes without links are absent.

    Each round links every node's larger neighbours to its smallest one and then all its neighbours up to
    itself; rows of a hot node are aggregated before they are shuffled. Null ends are not links.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = shared.written(links, "links")
    last = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        older, links = links, shared.written(small, "links")
        shared.drop(older)
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    stars = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = links.select(F.col("b").alias("node")).distinct().join(stars.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return stars.unionByName(roots)
