"""Connected components by contraction: Spark joins only, nothing of the graph on the driver.

Each round every node points to its least neighbour or itself, pointers are doubled until all lead to a root, and the
links between different roots are what is left for the next round. Roots are the least nodes of their trees, so the
last root of a node is the least node of its component. Tables of each round lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Shared


def connected(links: DataFrame, shared: Shared) -> DataFrame:
    """links: a, b of any orderable type. Returns node, root for every node with a link to another one."""
    left, where = shared.put(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = shared.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))[0]
        while True:
            up = stars.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
            stars, at = shared.put(stars.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            if stars.where("moved").isEmpty():
                break
            stars = stars.drop("moved")
        stars = stars.drop("moved")
        roots = stars if roots is None else shared.put(roots.join(stars.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))[0]
        a, b = stars.toDF("a", "ra"), stars.toDF("b", "rb")
        kept, at = shared.put(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        shared.drop(where)
        left, where = kept, at
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where(F.lit(False))
    return roots
