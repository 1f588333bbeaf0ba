"""Metrics of the semantic model, usage figures and result statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import stats
from sparkloom.semantic.model import Measure, Metric, compute, star
from sparkloom.sources.tables import read

from . import Registry

query = Registry()


def _metric(spark, d, metric, scope=None, places=6):
    df = compute(star(spark, d), metric, scope)
    return df.withColumn(metric.name, F.round(metric.name, places))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1")
def metric_measure(spark, d):
    return _metric(spark, d, Metric("amount", "MEASURE", Measure("sum", "l_extendedprice", table="line"), grain=("l_returnflag",)), places=2)


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / nullif(sum(l_quantity), 0), 6) AS returned FROM lineitem GROUP BY 1")
def metric_weighted_ratio(spark, d):
    return _metric(spark, d, Metric("returned", "RATIO", Measure("sum", "l_quantity", "l_returnflag = 'R'", "line"), Measure("sum", "l_quantity", table="line"), grain=("l_suppkey",)))


@query("SELECT l_suppkey, round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS price FROM lineitem GROUP BY 1")
def metric_avg_of_ratios(spark, d):
    return _metric(spark, d, Metric("price", "RATIO", Measure("sum", "l_extendedprice", table="line"), Measure("sum", "l_quantity", table="line"), "AVG_OF_RATIOS", grain=("l_suppkey",)))


@query("SELECT l_linestatus, round(sum(l_extendedprice) - sum(l_extendedprice * l_discount), 2) AS net FROM lineitem GROUP BY 1")
def metric_difference(spark, d):
    return _metric(spark, d, Metric("net", "DIFFERENCE", Measure("sum", "l_extendedprice", table="line"), Measure("sum", "l_extendedprice * l_discount", table="line"), grain=("l_linestatus",)), places=2)


@query("""SELECT o_orderpriority, round(count(CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'P' THEN 1 END) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS done
FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus = 'O') GROUP BY 1""")
def metric_filter_case(spark, d):
    return _metric(spark, d, Metric("done", "RATIO", Measure("count", None, "o_orderstatus = 'F' or o_orderstatus = 'P'", "order"), Measure("count", table="order"), filters=("o_totalprice > 100000 or o_orderstatus = 'O'",), grain=("o_orderpriority",)))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def metric_cross_table(spark, d):
    return _metric(spark, d, Metric("revenue", "MEASURE", Measure("sum", "l_extendedprice * (1 - l_discount)", table="line"), grain=("n_name",)), places=2)


@query("""SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def metric_time_scope(spark, d):
    return compute(star(spark, d), Metric("buyers", "MEASURE", Measure("count_distinct", "o_custkey", table="order"), time_column="o_orderdate", grain=("o_orderstatus",)), ("1998-01-01", "1999-01-01"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def usage_daily(spark, d):
    rows = read(spark, d, "events").filter("ts >= timestamp'2024-01-15' and ts < timestamp'2024-01-25'")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def usage_by_type(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("""SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, sha256(arg_max(text, turn)) AS last_hash, count(*) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY 1""")
def usage_session_last(spark, d):
    last = F.max_by(F.struct("role", "text"), "turn")
    df = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), last.alias("last"), F.count_if(F.col("role") == "user").alias("asked"))
    return df.select("conv_id", "turns", F.col("last.role").alias("last_role"), F.sha2("last.text", 256).alias("last_hash"), "asked")


@query("""WITH layers AS (SELECT unnest(['click', 'view', 'purchase', 'cache']) AS layer),
per AS (SELECT event_type AS layer, count(*) AS hits, avg(value) AS mean FROM events GROUP BY 1)
SELECT layer, coalesce(hits, 0) AS hits, round(coalesce(mean, 0), 4) AS mean,
round((SELECT sum(mean * hits) / nullif(sum(hits), 0) FROM per WHERE layer IN ('click', 'view', 'purchase', 'cache')), 4) AS overall FROM layers LEFT JOIN per USING (layer)""")
def usage_weighted_avg(spark, d):
    layers = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "cache")], "layer string")
    per = read(spark, d, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count(F.lit(1)).alias("hits"), F.avg("value").alias("mean"))
    known = layers.join(per, "layer", "left")
    overall = known.agg((F.sum(F.col("mean") * F.col("hits")) / F.nullif(F.sum("hits"), F.lit(0))).alias("overall"))
    return known.join(F.broadcast(overall)).select("layer", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean"), F.round("overall", 4).alias("overall"))


@query("""SELECT count(*) AS total, min(l_quantity) AS q_min, max(l_quantity) AS q_max, round(avg(l_quantity), 4) AS q_avg, round(sum(l_quantity), 2) AS q_sum,
count(DISTINCT f) + max(CASE WHEN f IS NULL THEN 1 ELSE 0 END) AS flags FROM (SELECT *, nullif(l_returnflag, 'A') AS f FROM lineitem)""")
def stat_profile(spark, d):
    df = read(spark, d, "lineitem").withColumn("f", F.nullif(F.col("l_returnflag"), F.lit("A")))
    p = stats.profile(df, ["l_quantity"], ["f"])
    return p.select("total", F.col("l_quantity_min").alias("q_min"), F.col("l_quantity_max").alias("q_max"), F.round("l_quantity_avg", 4).alias("q_avg"), F.round("l_quantity_sum", 2).alias("q_sum"), F.col("f_distinct").alias("flags"))


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_brand <> '' GROUP BY 1), t AS (SELECT sum(n) AS all_n FROM c)
SELECT value, n, round(100.0 * n / all_n, 1) AS share FROM c, t ORDER BY n DESC, value LIMIT 5""")
def stat_top_contrib(spark, d):
    return stats.top_contributors(read(spark, d, "part"), "p_brand")


@query("SELECT round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, round(avg(o_totalprice), 2) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 2) AS std FROM orders")
def stat_distribution(spark, d):
    return stats.distribution(read(spark, d, "orders"), "o_totalprice")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)
SELECT period, v, CASE WHEN p <> 0 THEN round((v - p) / p * 100, 1) END AS change FROM (SELECT *, lag(v) OVER (ORDER BY period) AS p FROM m)""")
def stat_mom(spark, d):
    months = read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return stats.change(months, "period", "v")


@query("""WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd, count(v) AS n FROM g)
SELECT l_suppkey, round((v - m) / sd, 2) AS z FROM g, s WHERE n >= 2 AND sd > 0 AND round((v - m) / sd, 2) > 1.5""")
def stat_zscore(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    return stats.outliers(g, "v", 1.5).select("l_suppkey", "z")


@query("""SELECT count(*) AS n, count(DISTINCT l_returnflag) AS card1, count(DISTINCT l_linestatus) AS card2,
round(count(DISTINCT (l_returnflag, l_linestatus)) / nullif(CAST(count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) AS DOUBLE), 0), 4) AS coverage,
count(DISTINCT (l_returnflag, l_linestatus)) = count(DISTINCT l_returnflag) AND count(DISTINCT (l_returnflag, l_linestatus)) = count(DISTINCT l_linestatus) AS bijective FROM lineitem""")
def stat_chart_signals(spark, d):
    return stats.chart_signals(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH y AS (SELECT o_orderpriority AS segment, sum(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END) AS before, sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END) AS after FROM orders GROUP BY 1),
c AS (SELECT segment, round((after - before) / nullif(before, 0) * 100, 2) AS change FROM y)
SELECT segment, change, CASE WHEN change IS NULL OR change = 0 OR abs(change) < 5 THEN 'inconclusive' WHEN change > 0 THEN 'supported' ELSE 'contradicted' END AS verdict FROM c""")
def stat_hypothesis_verdict(spark, d):
    when = lambda c: F.sum(F.when(c, F.col("o_totalprice")))
    cut = F.lit("1998-01-01").cast("timestamp")
    y = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("segment")).agg(when(F.col("o_orderdate") < cut).alias("before"), when(F.col("o_orderdate") >= cut).alias("after"))
    c = y.select("segment", F.round((F.col("after") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100, 2).alias("change"))
    return c.withColumn("verdict", stats.verdict(F.col("change"), 1, 5.0))


@query("""SELECT segment, variable, round(value, 2) AS value FROM (SELECT o_orderstatus AS segment, round(stddev_samp(o_totalprice), 4) AS std, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1)
UNPIVOT (value FOR variable IN (std, med, p90))""")
def stat_spread(spark, d):
    q = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("segment")).agg(
        F.round(F.stddev_samp("o_totalprice"), 4).alias("std"), F.round(F.median("o_totalprice"), 4).alias("med"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90")
    )
    return q.unpivot("segment", ["std", "med", "p90"], "variable", "value").withColumn("value", F.round("value", 2))


@query("SELECT max(share) <= 1 + 1e-9 AS shares_ok, max(total) <= 1 + 1e-9 AS sums_ok FROM (SELECT share, sum(share) OVER () AS total FROM (SELECT c_mktsegment, count(*) / nullif(CAST(sum(count(*)) OVER () AS DOUBLE), 0) AS share FROM customer GROUP BY 1))")
def stat_share_invariants(spark, d):
    n = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return stats.share_invariants(n.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")), "share")
