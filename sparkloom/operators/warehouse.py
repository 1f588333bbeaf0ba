"""Layered warehouse: cleaning, dimensions, facts, monthly marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.sources.shared import saved

from sparkloom.semantic.model import ratio


def month(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def clean_blank(c: Column) -> Column:
    """A text without its outer spaces; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_date(c: Column, sentinel: str = "1900-01-01") -> Column:
    """Null up to the sentinel day."""
    return F.when(c > F.lit(sentinel).cast("timestamp"), c)


def clean_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def clean_amounts(df: DataFrame, quantity: str, amounts: list[str], most: float = 1e9) -> DataFrame:
    """An impossible quantity takes its amounts with it."""
    ok = F.col(quantity) <= most
    return df.withColumns({c: F.when(ok, F.col(c)) for c in [*amounts, quantity]})


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")
    return days.select(
        F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), "day", F.year("day").alias("year"), F.quarter("day").alias("quarter"),
        F.month("day").alias("month"), F.dayofmonth("day").alias("day_of_month"), (F.dayofweek("day") - 1).alias("weekday"),
        F.weekofyear("day").alias("iso_week"), F.last_day("day").alias("month_end"), (F.dayofweek("day").isin(1, 7)).alias("weekend"),
    )


def surrogate(df: DataFrame, code: str, key: str) -> DataFrame:
    """Numbers from 1 in the order of codes, for a dimension: codes are dealt by range, numbered in each part, and the parts' counts added before."""
    codes = saved(df.select(code).filter(F.col(code).isNotNull()).distinct().repartitionByRange(code).withColumn("__part", F.spark_partition_id()), "codes")
    counts = codes.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    begin = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    numbered = codes.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(code)))
    return numbered.join(F.broadcast(counts.select("__part", begin.alias("__begin"))), "__part").select(code, (F.col("__begin") + F.col("__rn")).cast("int").alias(key))


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def receipts(lines: DataFrame, orders: DataFrame, promise_days: int = 30) -> DataFrame:
    """Receipt lines with the promised date of their order."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", F.date_add(F.to_date("o_orderdate"), promise_days).alias("promised"))
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).withColumn("received", F.to_date("l_shipdate"))


def delivery(receipts_: DataFrame) -> DataFrame:
    """Monthly punctuality of a supplier."""
    on_time = F.col("received") <= F.col("promised")
    late_days = F.when(~on_time, F.date_diff("received", "promised"))
    return receipts_.groupBy("l_suppkey", month("received").alias("year_month")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(on_time).alias("on_time"),
        F.count_if(~on_time).alias("late"),
        F.round(ratio(F.count_if(on_time), F.count(F.lit(1))), 4).alias("otd_rate"),
        F.round(F.avg(late_days), 1).alias("mean_late_days"),
    )


def purchase(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Monthly purchases from a supplier. One line of an order, supplier and month is marked where the lines meet their order, so orders are a
    sum and parts the groups of one aggregate; two distinct counts would have Spark send each line three times."""
    df = lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").join(orders.select("o_orderkey", F.trunc("o_orderdate", "month").alias("__month")), F.col("l_orderkey") == F.col("o_orderkey"))
    one = Window.partitionBy("l_orderkey", "l_suppkey", "__month").orderBy(F.lit(0))
    df = df.withColumn("__first", (F.row_number().over(one) == 1).cast("long"))
    parts = df.groupBy("l_suppkey", "__month", "l_partkey").agg(
        F.sum("__first").alias("__orders"), F.count(F.lit(1)).alias("__lines"), F.sum("l_quantity").alias("__quantity"), F.sum("l_extendedprice").alias("__amount")
    )
    return parts.groupBy("l_suppkey", month("__month").alias("year_month")).agg(
        F.sum("__orders").alias("orders"), F.count("l_partkey").alias("parts"), F.sum("__lines").alias("lines"), F.round(F.sum("__quantity"), 2).alias("quantity"), F.round(F.sum("__amount"), 2).alias("amount"),
    )


def quality(lines: DataFrame) -> DataFrame:
    rejected = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return lines.groupBy("l_suppkey", month("l_shipdate").alias("year_month")).agg(
        F.round(F.sum("l_quantity"), 2).alias("received"), F.round(F.sum(rejected), 2).alias("rejected"),
        F.round(ratio(F.sum(rejected), F.sum("l_quantity")), 4).alias("defect_rate"),
    )


def payment(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey", month("o_orderdate").alias("year_month")).agg(F.count(F.lit(1)).alias("payments"), F.round(F.sum("o_totalprice"), 2).alias("paid"))


def price(lines: DataFrame) -> DataFrame:
    unit = ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    return lines.groupBy("l_partkey", month("l_shipdate").alias("year_month")).agg(
        F.count(F.lit(1)).alias("price_lines"), F.round(F.min(unit), 8).alias("low"), F.round(F.max(unit), 8).alias("high"), F.round(F.avg(unit), 8).alias("mean")
    )


def supplier_360(suppliers: DataFrame, lines: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """Figures of the twelve months before a day: one aggregate by supplier, then a left join, in place of a subquery for each figure."""
    end = F.lit(as_of).cast("date")
    rows = receipts(lines, orders).filter((F.col("received") >= F.add_months(end, -12)) & (F.col("received") < end))
    on_time = F.col("received") <= F.col("promised")
    figures = rows.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count_distinct("l_partkey").alias("parts"),
        F.round(ratio(F.count_if(on_time), F.count(F.lit(1))), 4).alias("otd_rate"),
        F.round(ratio(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)), F.sum("l_quantity")), 4).alias("defect_rate"),
    )
    df = suppliers.join(figures, suppliers["s_suppkey"] == figures["l_suppkey"], "left")
    return df.select("s_suppkey", "s_name", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("parts", F.lit(0)).alias("parts"), "otd_rate", "defect_rate")


def order_detail(lines: DataFrame, orders: DataFrame, suppliers: DataFrame, parts: DataFrame) -> DataFrame:
    """Receipt lines with what is known of their order, supplier and part, and a delivery status."""
    promised = F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 30))
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    df = df.withColumn("promised", promised).withColumn("received", F.to_date("l_shipdate"))
    status = F.when(F.col("promised").isNull(), "NO_PROMISED_DATE").when(F.col("received") <= F.col("promised"), "ON_TIME").otherwise("LATE")
    return df.select("l_orderkey", "l_linenumber", "s_name", "p_name", "received", "promised", status.alias("status"), F.date_diff("received", "promised").alias("delay_days"))


def leftovers(df: DataFrame, dates: list[str], texts: list[str], sentinel: str = "1900-01-01") -> DataFrame:
    """One row of counts that a cleaned table should have at 0."""
    aggs = [F.count_if(F.col(c) <= F.lit(sentinel).cast("timestamp")).alias(f"{c}_sentinel") for c in dates]
    return df.agg(*aggs, *[F.count_if(F.trim(c) == "").alias(f"{c}_blank") for c in texts])
