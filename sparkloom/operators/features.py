"""Features (entity, value, valid_at), tiers of risk, supplier decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEVERITY = ["HIGH", "MEDIUM", "LOW"]


def months_back(as_of: str, months: int) -> Column:
    """The first day of the month so many months before that of a day; with the current month, months + 1 calendar months."""
    return F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -months)


def feature(df: DataFrame, feature_id: str, key: str, value: Column, valid_at: Column) -> DataFrame:
    return df.select(F.lit(feature_id).alias("feature_id"), F.col(key).cast("string").alias("entity_key"), value.cast("double").alias("value"), valid_at.alias("valid_at"))


def upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """The last row of each (feature_id, entity_key, valid_at)."""
    rows = target.withColumn("__o", F.lit(0)).unionByName(source.withColumn("__o", F.lit(1)))
    w = Window.partitionBy("feature_id", "entity_key", "valid_at").orderBy(F.desc("__o"))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__o", "__r")


def latest(values: DataFrame, as_of: str | None = None) -> DataFrame:
    """The newest value of each feature and entity, on a day or at all."""
    if as_of is not None:
        values = values.filter(F.col("valid_at") <= F.lit(as_of).cast("date"))
    return values.groupBy("feature_id", "entity_key").agg(F.max("valid_at").alias("valid_at"), F.max_by("value", "valid_at").alias("value"))


def tier(value: Column, rules: list[tuple[str, str, float]]) -> Column:
    """The worst tier whose rule (tier, operator, bound) holds; null if none does. operator: lt, lte, gt, gte, lt_inverse."""
    out = None
    for name, op, bound in sorted(rules, key=lambda r: SEVERITY.index(r[0])):
        holds = {"lt": value < bound, "lt_inverse": value < bound, "lte": value <= bound, "gt": value > bound, "gte": value >= bound}[op]
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def worst(*tiers: Column) -> Column:
    """The most severe of tiers that may be null."""
    rank = F.least(*[F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), t) for t in tiers])
    return F.get(F.array(*[F.lit(s) for s in SEVERITY]), (rank - 1).cast("int"))


def decision(score_tier: Column, others: list[Column], missing: Column) -> Column:
    """The score's tier, else UNKNOWN if everything is missing, else the worst other tier, else LOW."""
    return F.coalesce(score_tier, F.when(missing, "UNKNOWN"), worst(*others), F.lit("LOW"))
