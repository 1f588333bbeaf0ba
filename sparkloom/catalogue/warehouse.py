"""Warehouse layers, incremental loads, set comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import sets
from sparkloom.operators import warehouse as W
from sparkloom.sources import tables as T
from sparkloom.sources.tables import read

from . import Registry

query = Registry()

RECEIPTS = """r AS (SELECT l.*, CAST(l_shipdate AS DATE) AS received, CAST(o_orderdate AS DATE) + 30 AS promised FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""


@query("""SELECT CAST(strftime(day, '%Y%m%d') AS INT) AS date_key, day, CAST(year(day) AS INT) AS year, CAST(quarter(day) AS INT) AS quarter, CAST(month(day) AS INT) AS month, CAST(day(day) AS INT) AS day_of_month,
CAST(dayofweek(day) AS INT) AS weekday, CAST(weekofyear(day) AS INT) AS iso_week, last_day(day) AS month_end, dayofweek(day) IN (0, 6) AS weekend
FROM (SELECT CAST(unnest(generate_series(DATE '2012-01-01', DATE '2027-12-31', INTERVAL 1 DAY)) AS DATE) AS day)""")
def dim_date(spark, d):
    return W.dim_date(spark, "2012-01-01", "2027-12-31")


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) AS INT) AS brand_key FROM (SELECT DISTINCT p_brand FROM part)")
def dim_surrogate(spark, d):
    return W.surrogate(read(spark, d, "part"), "p_brand", "brand_key")


@query("SELECT o_orderstatus AS code FROM orders UNION SELECT l_linestatus FROM lineitem UNION SELECT l_returnflag FROM lineitem")
def dim_union_distinct(spark, d):
    lines = read(spark, d, "lineitem")
    return W.union_distinct([read(spark, d, "orders").select(F.col("o_orderstatus").alias("code")), lines.select("l_linestatus"), lines.select("l_returnflag")])


@query("""SELECT l_suppkey, strftime(o_orderdate, '%Y-%m') AS year_month, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) AS lines,
round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def dws_purchase(spark, d):
    return W.purchase(read(spark, d, "lineitem"), read(spark, d, "orders"))


@query(f"""WITH {RECEIPTS} SELECT l_suppkey, strftime(received, '%Y-%m') AS year_month, count(*) AS lines, count(*) FILTER (WHERE received <= promised) AS on_time,
count(*) FILTER (WHERE received > promised) AS late, round(count(*) FILTER (WHERE received <= promised) / nullif(CAST(count(*) AS DOUBLE), 0), 4) AS otd_rate,
round(avg(CASE WHEN received > promised THEN received - promised END), 1) AS mean_late_days FROM r GROUP BY 1, 2""")
def dws_delivery_otd(spark, d):
    return W.delivery(W.receipts(read(spark, d, "lineitem"), read(spark, d, "orders")))


@query("""SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS year_month, round(sum(l_quantity), 2) AS received, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS rejected,
round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS defect_rate FROM lineitem GROUP BY 1, 2""")
def dws_quality(spark, d):
    return W.quality(read(spark, d, "lineitem"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS payments, round(sum(o_totalprice), 2) AS paid FROM orders GROUP BY 1, 2")
def dws_payment(spark, d):
    return W.payment(read(spark, d, "orders"))


@query("""SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS year_month, count(*) AS price_lines, round(min(l_extendedprice / nullif(l_quantity, 0)), 8) AS low,
round(max(l_extendedprice / nullif(l_quantity, 0)), 8) AS high, round(avg(l_extendedprice / nullif(l_quantity, 0)), 8) AS mean FROM lineitem GROUP BY 1, 2""")
def dws_price(spark, d):
    return W.price(read(spark, d, "lineitem"))


@query(f"""WITH {RECEIPTS}, f AS (SELECT l_suppkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS amount, count(DISTINCT l_partkey) AS parts,
round(count(*) FILTER (WHERE received <= promised) / nullif(CAST(count(*) AS DOUBLE), 0), 4) AS otd_rate,
round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS defect_rate
FROM r WHERE received >= DATE '2000-01-01' AND received < DATE '2001-01-01' GROUP BY 1)
SELECT s_suppkey, s_name, coalesce(lines, 0) AS lines, coalesce(amount, 0) AS amount, coalesce(parts, 0) AS parts, otd_rate, defect_rate FROM supplier LEFT JOIN f ON s_suppkey = l_suppkey""")
def ads_supplier_360(spark, d):
    return W.supplier_360(read(spark, d, "supplier"), read(spark, d, "lineitem"), read(spark, d, "orders"), "2001-01-01")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, s_name, p_name, CAST(l_shipdate AS DATE) AS received, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS promised
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey)
SELECT *, CASE WHEN promised IS NULL THEN 'NO_PROMISED_DATE' WHEN received <= promised THEN 'ON_TIME' ELSE 'LATE' END AS status, CAST(received - promised AS INT) AS delay_days FROM x""")
def ads_order_detail(spark, d):
    return W.order_detail(read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "supplier"), read(spark, d, "part"))


@query("""SELECT l_orderkey, CASE WHEN l_shipdate > TIMESTAMP '1997-01-01' THEN l_shipdate END AS shipped, nullif(trim(CASE WHEN l_returnflag = 'A' THEN ' ' ELSE l_returnflag END), '') AS flag,
nullif(l_tax, 0) AS tax, CASE WHEN l_quantity <= 40 THEN l_quantity END AS quantity, CASE WHEN l_quantity <= 40 THEN l_extendedprice END AS amount FROM lineitem""")
def clean_sentinels(spark, d):
    df = read(spark, d, "lineitem").select(
        "l_orderkey", W.clean_date(F.col("l_shipdate"), "1997-01-01").alias("shipped"),
        W.clean_blank(F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag"))).alias("flag"),
        W.clean_zero(F.col("l_tax")).alias("tax"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
    )
    return W.clean_amounts(df, "quantity", ["amount"], 40.0)


@query("SELECT count(*) FILTER (WHERE l_shipdate <= TIMESTAMP '1900-01-01') AS l_shipdate_sentinel, count(*) FILTER (WHERE trim(l_returnflag) = '') AS l_returnflag_blank FROM lineitem")
def clean_assertions(spark, d):
    return W.leftovers(read(spark, d, "lineitem"), ["l_shipdate"], ["l_returnflag"])


@query("SELECT 'orders' AS \"table\", count(*) AS source_rows, count(*) FILTER (WHERE o_orderstatus <> 'P') AS target_rows, count(*) = count(*) FILTER (WHERE o_orderstatus <> 'P') AS agree FROM orders UNION ALL SELECT 'part', count(*), count(*), true FROM part")
def load_counts_agree(spark, d):
    orders, part = read(spark, d, "orders"), read(spark, d, "part")
    return T.counts_agree({"orders": orders, "part": part}, {"orders": orders.filter("o_orderstatus <> 'P'"), "part": part})


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01' OR o_orderdate >= TIMESTAMP '2000-01-01'")
def inc_upsert(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), "o_orderdate")
    target = orders.filter("o_orderdate < timestamp'2000-06-01'")
    source = T.since(orders, "o_orderdate", "2000-01-01").withColumn("price", F.round(F.col("price") * 2, 2))
    return T.merge(target, source, ["o_orderkey"]).drop("o_orderdate")


@query("SELECT greatest(coalesce((SELECT max(o_orderdate) FROM orders), TIMESTAMP '1900-01-01'), coalesce((SELECT max(l_shipdate) FROM lineitem WHERE l_quantity < 0), TIMESTAMP '1900-01-01')) AS watermark")
def inc_watermark(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").alias("at"))
    return T.next_watermark([o, read(spark, d, "lineitem").filter("l_quantity < 0").select(F.col("l_shipdate").alias("at"))], "at")


@query("""WITH t AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer)
SELECT s.c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'inserted' WHEN t.c_mktsegment <> s.c_mktsegment OR t.c_acctbal <> s.c_acctbal THEN 'updated' ELSE 'skipped' END AS status,
CASE WHEN t.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN t.c_mktsegment <> s.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN t.c_acctbal <> s.c_acctbal THEN 'c_acctbal' END) END AS changed FROM s LEFT JOIN t ON s.c_custkey = t.c_custkey""")
def upsert_outcomes(spark, d):
    c = read(spark, d, "customer")
    source = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 10 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return T.outcomes(c.filter("c_custkey % 3 <> 0"), source, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 1")
def upsert_insert_absent(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return T.insert_absent(c.filter("c_custkey % 4 <> 1"), c, ["c_custkey"])


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value FROM (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def value_domains(spark, d):
    return T.value_domains(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("""WITH a AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY 1)
SELECT 'left' AS side, k, v FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', k, v FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_multiset_diff(spark, d):
    a = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    b = a.filter("k % 11 <> 0").withColumn("v", F.col("v") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))
    return sets.multiset_difference(a, b)


@query("""WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.p, b.p)) / nullif(CAST(len(a.p) + len(b.p) - len(list_intersect(a.p, b.p)) AS DOUBLE), 0), 6) AS jaccard FROM s a JOIN s b ON b.k = a.k + 1""")
def set_jaccard(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"))
    b = s.select(F.col("k").alias("b"), (F.col("k") - 1).alias("a"), F.col("p").alias("q"))
    return s.join(b, F.col("k") == F.col("a")).select("a", "b", F.round(sets.jaccard(F.col("p"), F.col("q")), 6).alias("jaccard"))


@query("""WITH a AS (SELECT DISTINCT trim(CAST(l_partkey AS VARCHAR)) AS v FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT trim(CAST(p_partkey AS VARCHAR)) AS v FROM part WHERE p_size < 30)
SELECT (SELECT count(*) FROM a) AS left_n, (SELECT count(*) FROM b) AS right_n, count(*) AS common, round(count(*) / nullif(CAST(least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS DOUBLE), 0), 6) AS overlap FROM a JOIN b USING (v)""")
def set_overlap_health(spark, d):
    return sets.overlap_health(read(spark, d, "lineitem").filter("l_quantity > 48"), "l_partkey", read(spark, d, "part").filter("p_size < 30"), "p_partkey")


@query("""WITH a AS (SELECT l_suppkey AS k, round(avg(l_discount) * 100, 2) AS score FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' AND l_suppkey % 9 <> 0 GROUP BY 1), b AS (SELECT l_suppkey AS k, round(avg(l_discount) * 100, 2) AS score FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_suppkey % 8 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'NEW' WHEN b.k IS NULL THEN 'REMOVED' WHEN round(b.score - a.score, 2) >= 0.1 THEN 'IMPROVED' WHEN round(b.score - a.score, 2) <= -0.1 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS status FROM a FULL OUTER JOIN b ON a.k = b.k""")
def set_snapshot_diff(spark, d):
    lines, cut = read(spark, d, "lineitem"), "timestamp'1998-06-01'"
    # decimals: a sum of doubles depends on the order of the rows, and halves fall either way
    exact = F.avg(F.col("l_discount").cast("decimal(28,12)"))
    score = lambda df: df.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(exact * 100, 2).cast("double").alias("score"))
    a, b = score(lines.filter(f"l_shipdate < {cut} and l_suppkey % 9 <> 0")), score(lines.filter(f"l_shipdate >= {cut} and l_suppkey % 8 <> 0"))
    return sets.snapshot_difference(a, b, "k", "score", 0.1).select("k", "status")


@query("""WITH a AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 25 GROUP BY 1)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def set_count_merge(spark, d):
    part = read(spark, d, "part")
    n = lambda df: df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n(part.filter("p_size < 25")).unionByName(n(part.filter("p_size >= 25"))).groupBy("p_brand").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)
