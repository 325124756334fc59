"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, join_counted


def components(steps: Steps, links: DataFrame) -> DataFrame:
    """node and label for every node of the links (a, b); connected nodes share a label.

    Every round each node is merged into the neighbour (or itself) that comes first in a
    hashed order of that round, and links are rewritten; a fixed share of the nodes goes
    in each round, whatever the shape. Nodes with very many links are looked up by
    broadcast, so no task holds all links of one node.
    """
    maps: list[DataFrame] = []
    links = steps.store(links.where("a <> b").select("a", "b").distinct(), "links-0")
    while not links.isEmpty():
        k = len(maps)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        best = best.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["n"].alias("into"))
        maps.append(steps.store(best, f"map-{k}"))
        moved = links
        for end in ("a", "b"):
            to = maps[k].select(F.col("node").alias(end), F.col("into").alias("_to"))
            moved = join_counted(moved, to, end, F.xxhash64("a", "b")).drop(end).withColumnRenamed("_to", end)
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = steps.store(moved, f"links-{k + 1}")
        steps.drop(f"links-{k}")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = maps[-1].withColumnRenamed("into", "label")
    for k in range(len(maps) - 2, -1, -1):
        later = found.select(F.col("node").alias("into"), F.col("label"))
        found = join_counted(maps[k], later, "into", F.col("node"))
        found = steps.store(found.select("node", F.coalesce("label", "into").alias("label")), f"labels-{k}")
    return found
