"""Connected components: inside one task with numpy, over a table of links with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempaudit.session import scratch_path


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node that occurs in links ``u``, ``v``.

    Alternates two steps until no link changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours.  The number of links does not grow.  Groups are
    reduced to a minimum before they are shuffled, and a node with very many links meets its minimum in
    an inner join, which adaptive execution splits.  Each round is a written table, so that a lost
    executor repeats one round only.  Null ends and links of a node to itself are ignored.
    """
    spark = links.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    # links point from the larger node u to the smaller node v
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = written(links.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    seen = state(now)
    for _ in range(rounds if seen[0] else 0):
        # large step: around each node, all larger neighbours go to the smallest neighbour or the node itself
        smallest = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.withColumnRenamed("v", "c").join(smallest.withColumnRenamed("u", "c"), "c", "left").select("u", F.coalesce("m", "c").alias("v"))
        now = written(moved.distinct(), "links")
        # small step: around each node, all smaller neighbours go to the smallest of them
        smallest = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(moved.filter("u <> v").unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, seen = seen, state(now)
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"links still change after {rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
