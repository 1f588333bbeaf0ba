"""Connected components of an edge table by smallest labels and pointer jumping, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, saved

#: A node of more edges meets its label in SALTS places.
HEAVY, SALTS = 2_000, 64


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of edges (a, b) the smallest node reachable. Rounds grow with the logarithm of the longest path.

    Nothing is collected but the number of changed labels. Nulls and loops are ignored.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    # what a node b is linked to is tied to the smallest of it instead, and b to that one alone: fewer edges, same components
    least = edges.select(F.min("a").over(Window.partitionBy("b")).alias("m"), "a", "b")
    edges = least.select(F.col("m").alias("a"), "b").unionByName(least.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    heavy = broadcast_if_small(saved(both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HEAVY).select("node"), "heavy"))
    marked = both.join(heavy.select(F.col("node").alias("b"), F.lit(True).alias("many")), "b", "left")
    both = saved(marked.select("a", "b", F.when(F.col("many"), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")), "salted-edges")

    def spread(labels: DataFrame) -> DataFrame:
        """(b, salt, label): a heavy node's label once for each salt."""
        last = F.when(F.col("many"), F.lit(SALTS - 1)).otherwise(F.lit(0))
        rows = labels.join(heavy.select("node", F.lit(True).alias("many")), "node", "left")
        return rows.select(F.col("node").alias("b"), "label", F.explode(F.sequence(F.lit(0), last)).alias("salt"))

    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(spread(labels), ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        best = saved(best, "labels")
        jump = best.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = best.join(jump, "label").select("node", "before", F.least("label", "further").alias("label"))
        new = saved(new, "labels")
        changed = not new.filter("label <> before").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
