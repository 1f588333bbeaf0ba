"""Comparing sets, multisets and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def multiset_difference(left: DataFrame, right: DataFrame, places: int = 6) -> DataFrame:
    """Rows that one side has more often, with their side; doubles are rounded, texts trimmed, so order and noise don't count."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the columns differ")

    def plain(df: DataFrame) -> DataFrame:
        shape = {"double": lambda c: F.round(c, places), "string": F.trim}
        return df.select(*[shape.get(kind, lambda c: c)(F.col(c)).alias(c) for c, kind in ((c, dict(df.dtypes)[c]) for c in left.columns)])

    a, b = plain(left), plain(right)
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def overlap_health(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row: the distinct trimmed values of each side, those in common, and their share of the smaller side. 0 marks a dead join."""
    a = left.select(F.trim(F.col(left_column).cast("string")).alias("v")).filter("v is not null").distinct()
    b = right.select(F.trim(F.col(right_column).cast("string")).alias("v")).filter("v is not null").distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "v", "full_outer")
    n = sides.agg(F.count("l").alias("left_n"), F.count("r").alias("right_n"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))
    return n.withColumn("overlap", F.round(F.col("common") / F.nullif(F.least("left_n", "right_n"), F.lit(0)), 6))


def snapshot_difference(before: DataFrame, after: DataFrame, key: str, score: str, step: float = 1.0) -> DataFrame:
    """NEW, REMOVED, IMPROVED, REGRESSED or UNCHANGED for each key of either side."""
    both = before.select(key, F.col(score).alias("before"), F.lit(True).alias("__b")).join(after.select(key, F.col(score).alias("after"), F.lit(True).alias("__a")), key, "full_outer")
    delta = F.round(F.col("after") - F.col("before"), 2)
    status = F.when(F.col("__b").isNull(), "NEW").when(F.col("__a").isNull(), "REMOVED").when(delta >= step, "IMPROVED").when(delta <= -step, "REGRESSED").otherwise("UNCHANGED")
    return both.select(key, "before", "after", status.alias("status"))


def changed_fields(left: str, right: str, fields: list[str]) -> Column:
    """Names of the fields of two aliased sides whose values differ; nulls are equal."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]))
