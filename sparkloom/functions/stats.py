"""Result statistics: profiles, contributions, changes, outliers, chart signals, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DETAIL_COLUMNS = 5


def profile(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row in one pass: total; min, max, avg and sum of numbers; distinct counts of texts, null being a value."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("total")]
    for c in numbers[:DETAIL_COLUMNS]:
        aggs += [f(c).alias(f"{c}_{name}") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("sum", F.sum))]
    for c in texts[:DETAIL_COLUMNS]:
        aggs.append((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"{c}_distinct"))
    return df.agg(*aggs)


def compressed(df: DataFrame, column: str, top: int = 5, distinct: int = 50) -> DataFrame:
    """One row: the largest values by amount, and the first distinct ones in order."""
    biggest = df.select(F.abs(column).alias("size"), column).filter(F.col(column).isNotNull()).orderBy(F.desc("size"), column).limit(top)
    few = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(distinct)
    return biggest.agg(F.array_sort(F.collect_list(column)).alias("largest")).join(F.broadcast(few.agg(F.array_sort(F.collect_list(column)).alias("values"))))


def top_contributors(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n, share in %): null and empty values count neither in nor below."""
    counts = df.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all_n"), 1).alias("share")).orderBy(F.desc("n"), "value").limit(k)


def distribution(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.round(F.min(c), 2).alias("least"), F.round(F.max(c), 2).alias("most"), F.round(F.avg(c), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 2).alias("std"))


def change(df: DataFrame, period: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Change in % against the period before. df has one row for each period (of each group), so the window is over few rows."""
    w = Window.partitionBy(*(by or [])).orderBy(period)
    before = F.lag(value).over(w)
    return df.withColumn("change", F.when(before != 0, F.round((F.col(value) - before) / before * 100, 1)))


def outliers(df: DataFrame, column: str, above: float = 2.0) -> DataFrame:
    """Rows with z above a bound: z is rounded first, only the high side counts, and one value or no spread has none."""
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"), F.count(column).alias("__n"))
    z = F.round((F.col(column) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), 2)
    return df.join(F.broadcast(s)).filter("__n >= 2").withColumn("z", z).filter(F.col("z") > above).drop("__m", "__s", "__n")


def chart_signals(df: DataFrame, first: str, second: str) -> DataFrame:
    pair = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    s = pair.agg(F.sum("n").alias("n"), F.count_distinct(first).alias("card1"), F.count_distinct(second).alias("card2"), F.count(F.lit(1)).alias("pairs"))
    return s.select(
        "n", "card1", "card2",
        F.round(F.col("pairs") / F.nullif(F.col("card1") * F.col("card2"), F.lit(0)), 4).alias("coverage"),
        ((F.col("pairs") == F.col("card1")) & (F.col("pairs") == F.col("card2"))).alias("bijective"),
    )


def chart_kind(n: int, card1: int, card2: int, coverage: float, has_time: bool, is_share: bool) -> str:
    """The kind of chart for a small result, by ordered rules on its signals."""
    if n == 0:
        return "none"
    if n == 1:
        return "number"
    if has_time:
        return "line"
    if card2 > 1 and coverage >= 0.6:
        return "heatmap"
    if is_share and card1 <= 6:
        return "pie"
    return "horizontal_bar" if card1 > 15 else "bar"


def verdict(change_pct: Column, direction: int, least: float) -> Column:
    """Of a hypothesis that a figure rises (1) or falls (-1)."""
    weak = change_pct.isNull() | (change_pct == 0) | (F.abs(change_pct) < least)
    return F.when(weak, "inconclusive").when(F.signum(change_pct) == direction, "supported").otherwise("contradicted")


def share_invariants(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.max(column) <= 1 + 1e-9).alias("shares_ok"), (F.sum(column) <= 1 + 1e-9).alias("sums_ok"))


def confidence(complete: Column, by_rule: Column, history: Column, evidence: Column, stale: Column, conflict: Column) -> Column:
    """0 to 3, or null where evidence is missing, stale or in conflict."""
    score = F.when(complete, 1).otherwise(0) + F.when(by_rule, 1).otherwise(0) + F.when(history, 2).otherwise(0)
    return F.when(evidence & ~stale & ~conflict, F.least(score, F.lit(3)))
