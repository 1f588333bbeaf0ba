"""Data quality, features, risk and record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import dq, features, warehouse as W
from sparkloom.semantic.model import ratio
from sparkloom.sources.tables import read

from . import Registry

query = Registry()
LINES = ("lineitem", "orders", "supplier", "part")


def _frames(spark, d):
    f = dq.reader(spark, d, [*LINES, "customer"])
    f["lineitem"] = f["lineitem"].withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("A"))).withColumn("l_suppkey", F.when(F.col("l_suppkey") % 17 != 3, F.col("l_suppkey")).otherwise(F.col("l_suppkey") + 1_000_000))
    return f


RULES = [
    dq.Rule("flag.filled", "COMPLETENESS", "lineitem", "flag", threshold=50),
    dq.Rule("order.unique", "UNIQUENESS", "orders", "o_orderkey"),
    dq.Rule("customer.unique", "UNIQUENESS", "orders", "o_custkey", threshold=5),
    dq.Rule("quantity.range", "VALIDITY", "lineitem", "l_quantity", dq.condition("range", "l_quantity", low=1, high=45), 90),
    dq.Rule("flag.set", "VALIDITY", "lineitem", "flag", dq.condition("in_set", "flag", values=["R", "N"]), 60),
    dq.Rule("name.shape", "VALIDITY", "part", "p_brand", dq.condition("regex", "p_brand", pattern="^Brand#[0-9]+$")),
    dq.Rule("price.quantity", "CONSISTENCY", "lineitem", "l_extendedprice", dq.condition("cross_column", "l_extendedprice", operator=">=", other="l_quantity", factor=1000), 50),
    dq.Rule("supplier.known", "REFERENTIAL", "lineitem", "l_suppkey", reference=("supplier", "s_suppkey"), threshold=99),
    dq.Rule("customer.known", "REFERENTIAL", "orders", "o_custkey", reference=("customer", "c_custkey")),
]

SQL_ROWS = """l AS (SELECT *, nullif(l_returnflag, 'A') AS flag, CASE WHEN l_suppkey % 17 <> 3 THEN l_suppkey ELSE l_suppkey + 1000000 END AS sk FROM lineitem),
e AS (SELECT 'flag.filled' AS code, 'COMPLETENESS' AS kind, 'lineitem' AS table_name, 50.0::DOUBLE AS threshold, count(flag) AS passed, count(*) AS total FROM l
UNION ALL SELECT 'order.unique', 'UNIQUENESS', 'orders', 100.0, count(DISTINCT o_orderkey), count(*) FROM orders
UNION ALL SELECT 'customer.unique', 'UNIQUENESS', 'orders', 5.0, count(DISTINCT o_custkey), count(*) FROM orders
UNION ALL SELECT 'quantity.range', 'VALIDITY', 'lineitem', 90.0, count(*) FILTER (WHERE l_quantity >= 1 AND l_quantity <= 45), count(*) FROM l
UNION ALL SELECT 'flag.set', 'VALIDITY', 'lineitem', 60.0, count(*) FILTER (WHERE flag IN ('R', 'N')), count(*) FROM l
UNION ALL SELECT 'name.shape', 'VALIDITY', 'part', 100.0, count(*) FILTER (WHERE regexp_matches(p_brand, '^Brand#[0-9]+$')), count(*) FROM part
UNION ALL SELECT 'price.quantity', 'CONSISTENCY', 'lineitem', 50.0, count(*) FILTER (WHERE l_extendedprice >= l_quantity * 1000), count(*) FROM l
UNION ALL SELECT 'supplier.known', 'REFERENTIAL', 'lineitem', 99.0, count(*) FILTER (WHERE sk IN (SELECT s_suppkey FROM supplier)), count(*) FROM l
UNION ALL SELECT 'customer.known', 'REFERENTIAL', 'orders', 100.0, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)), count(*) FROM orders),
x AS (SELECT *, coalesce(round(passed / nullif(CAST(total AS DOUBLE), 0) * 100, 4), 0) AS pass_rate FROM e)"""


def _of(kind):
    def run(spark, d):
        return dq.evaluate(_frames(spark, d), [r for r in RULES if r.kind == kind])

    run.__name__ = f"dq_{kind.lower()}"
    return query(f"WITH {SQL_ROWS} SELECT *, CASE WHEN pass_rate >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM x WHERE kind = '{kind}'")(run)


for _kind in ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "REFERENTIAL"):
    _of(_kind)


@query("""SELECT * FROM (SELECT 'unique' AS rule, l_orderkey AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS c FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE c > 6 GROUP BY 2
UNION ALL SELECT 'range', l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity >= 1 AND l_quantity <= 45)
UNION ALL SELECT 'orphan', l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 17 = 3)""")
def dq_violations(spark, d):
    f = _frames(spark, d)
    many = f["lineitem"].select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c")).filter("c > 6")
    bad = dq.violations(f, RULES[3], ["l_orderkey", "l_linenumber"], None).select(F.lit("range").alias("rule"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    lost = dq.violations(f, RULES[7], ["l_orderkey", "l_linenumber"], None).select(F.lit("orphan").alias("rule"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    return many.select(F.lit("unique").alias("rule"), F.col("l_orderkey").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(bad).unionByName(lost)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) ORDER BY o_custkey, o_orderkey LIMIT 20")
def dq_duplicate_samples(spark, d):
    return dq.violations(_frames(spark, d), RULES[2], ["o_custkey", "o_orderkey"], 20)


@query(f"""WITH {SQL_ROWS}, b AS (SELECT table_name, kind, avg(pass_rate) AS score FROM x GROUP BY 1, 2 UNION ALL SELECT '*', kind, avg(pass_rate) FROM x GROUP BY kind)
SELECT table_name, kind, round(score, 2) AS score FROM b UNION ALL SELECT table_name, 'OVERALL', round(avg(score), 2) FROM b GROUP BY 1""")
def dq_scores(spark, d):
    return dq.scores(dq.evaluate(_frames(spark, d), RULES))


@query(f"""WITH {SQL_ROWS}, a AS (SELECT table_name, kind, round(avg(pass_rate), 2) AS score FROM x GROUP BY 1, 2), b AS (SELECT table_name, kind, CASE kind WHEN 'VALIDITY' THEN score - 2 WHEN 'UNIQUENESS' THEN score + 3 ELSE score END AS score FROM a WHERE kind <> 'CONSISTENCY' UNION ALL SELECT 'region', 'COMPLETENESS', 100.0)
SELECT coalesce(a.table_name, b.table_name) || '/' || coalesce(a.kind, b.kind) AS k, a.score AS before, round(b.score, 2) AS after, CASE WHEN a.kind IS NULL THEN 'NEW' WHEN b.kind IS NULL THEN 'REMOVED' WHEN round(b.score - a.score, 2) >= 1 THEN 'IMPROVED' WHEN round(b.score - a.score, 2) <= -1 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS status
FROM a FULL OUTER JOIN b ON a.table_name = b.table_name AND a.kind = b.kind""")
def dq_report_compare(spark, d):
    from sparkloom.functions.sets import snapshot_difference

    s = dq.scores(dq.evaluate(_frames(spark, d), RULES)).filter("table_name <> '*' and kind <> 'OVERALL'")
    a = s.select(F.concat_ws("/", "table_name", "kind").alias("k"), "kind", "score")
    b = a.filter("kind <> 'CONSISTENCY'").withColumn("score", F.when(F.col("kind") == "VALIDITY", F.col("score") - 2).when(F.col("kind") == "UNIQUENESS", F.col("score") + 3).otherwise(F.col("score")))
    b = b.select("k", F.round("score", 2).alias("score")).unionByName(spark.createDataFrame([("region/COMPLETENESS", 100.0)], "k string, score double"))
    return snapshot_difference(a, b, "k", "score")


RECEIPTS = """r AS (SELECT l.*, CAST(l_shipdate AS DATE) AS received, CAST(o_orderdate AS DATE) + 30 AS promised, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""


def _receipts(spark, d):
    return W.receipts(read(spark, d, "lineitem"), read(spark, d, "orders"))


@query(f"WITH {RECEIPTS} SELECT 'otd_3m' AS feature_id, CAST(l_suppkey AS VARCHAR) AS entity_key, round(count(*) FILTER (WHERE received <= promised) / CAST(count(*) AS DOUBLE), 4) AS value, DATE '2000-07-01' AS valid_at FROM r WHERE received >= DATE '2000-04-01' AND received < DATE '2000-08-01' GROUP BY l_suppkey")
def feat_otd_3m(spark, d):
    end = F.lit("2000-08-01").cast("date")
    rows = _receipts(spark, d).filter((F.col("received") >= features.months_back("2000-07-15", 3)) & (F.col("received") < end))
    g = rows.groupBy("l_suppkey").agg(F.round(ratio(F.count_if(F.col("received") <= F.col("promised")), F.count(F.lit(1))), 4).alias("v"))
    return features.feature(g, "otd_3m", "l_suppkey", F.col("v"), F.lit("2000-07-01").cast("date"))


@query("SELECT 'defect_3m' AS feature_id, CAST(l_suppkey AS VARCHAR) AS entity_key, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS value, DATE '2000-07-01' AS valid_at FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-04-01' AND l_shipdate < TIMESTAMP '2000-08-01' GROUP BY l_suppkey")
def feat_defect(spark, d):
    rows = read(spark, d, "lineitem").filter((F.col("l_shipdate") >= features.months_back("2000-07-15", 3).cast("timestamp")) & (F.col("l_shipdate") < F.lit("2000-08-01").cast("timestamp")))
    bad = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    g = rows.groupBy("l_suppkey").agg(F.round(ratio(F.sum(bad), F.sum("l_quantity")), 4).alias("v"))
    return features.feature(g, "defect_3m", "l_suppkey", F.col("v"), F.lit("2000-07-01").cast("date"))


@query("SELECT l_partkey, round((max(p) - min(p)) / nullif(avg(p), 0) * 100, 3) AS variance_pct FROM (SELECT l_partkey, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) GROUP BY 1 HAVING count(*) >= 3")
def feat_price_var(spark, d):
    p = read(spark, d, "lineitem").select("l_partkey", ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"))
    g = p.groupBy("l_partkey").agg(F.round(ratio(F.max("p") - F.min("p"), F.avg("p")) * 100, 3).alias("variance_pct"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 3").drop("n")


RISK = f"""{RECEIPTS}, s AS (SELECT l_suppkey, round(count(*) FILTER (WHERE received <= promised) / CAST(count(*) AS DOUBLE), 4) AS otd, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS defect FROM r GROUP BY 1)"""


def _risk(spark, d):
    bad = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return _receipts(spark, d).groupBy("l_suppkey").agg(
        F.round(ratio(F.count_if(F.col("received") <= F.col("promised")), F.count(F.lit(1))), 4).alias("otd"), F.round(ratio(F.sum(bad), F.sum("l_quantity")), 4).alias("defect")
    )


@query(f"WITH {RISK} SELECT l_suppkey, round(0.6 * (1 - coalesce(otd, 0)) + 0.4 * coalesce(defect, 0), 4) AS risk FROM s")
def feat_risk_score(spark, d):
    return _risk(spark, d).select("l_suppkey", F.round(0.6 * (1 - F.coalesce("otd", F.lit(0.0))) + 0.4 * F.coalesce("defect", F.lit(0.0)), 4).alias("risk"))


@query("SELECT l_partkey, sum(l_quantity) AS need FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING sum(l_quantity) >= 400 AND count(DISTINCT l_suppkey) >= 3")
def feat_shortage_having(spark, d):
    g = read(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("need"), F.count_distinct("l_suppkey").alias("k"))
    return g.filter("need >= 400 and k >= 3").drop("k")


@query("""SELECT o_custkey, round(sum(coalesce(q, 0)) / nullif(CAST(count(*) AS DOUBLE), 0), 4) AS completion FROM orders LEFT JOIN (SELECT l_orderkey, 1 AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '2001-05-31' AND o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1""")
def feat_completion(spark, d):
    done = read(spark, d, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey").distinct().withColumn("q", F.lit(1))
    rows = read(spark, d, "orders").filter("o_orderdate >= timestamp'2001-05-31' and o_orderdate < timestamp'2001-07-01'")
    return rows.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.round(ratio(F.sum(F.coalesce("q", F.lit(0))), F.count(F.lit(1))), 4).alias("completion"))


@query("""WITH v AS (SELECT 'spend' AS feature_id, CAST(o_custkey AS VARCHAR) AS entity_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS valid_at, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2, 3)
SELECT feature_id, entity_key, max(valid_at) AS valid_at, arg_max(value, valid_at) AS value FROM v WHERE valid_at <= DATE '2000-06-15' GROUP BY 1, 2""")
def feat_latest(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "MM").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return features.latest(features.feature(g, "spend", "o_custkey", F.col("v"), F.col("m")), "2000-06-15")


@query(f"""WITH {RISK}, t AS (SELECT l_suppkey, CASE WHEN otd * 100 < 49 THEN 'HIGH' WHEN otd * 100 < 50 THEN 'MEDIUM' WHEN otd * 100 < 51 THEN 'LOW' END AS a, CASE WHEN defect * 100 > 36 THEN 'HIGH' WHEN defect * 100 > 34 THEN 'MEDIUM' END AS b FROM s)
SELECT s_suppkey, a AS otd_tier, b AS defect_tier, CASE WHEN l_suppkey IS NULL THEN 'UNKNOWN' WHEN a = 'HIGH' OR b = 'HIGH' THEN 'HIGH' WHEN a = 'MEDIUM' OR b = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM supplier LEFT JOIN t ON s_suppkey = l_suppkey""")
def feat_risk_tier(spark, d):
    t = _risk(spark, d).select(
        "l_suppkey", features.tier(F.col("otd") * 100, [("LOW", "lt", 51), ("HIGH", "lt", 49), ("MEDIUM", "lt_inverse", 50)]).alias("otd_tier"), features.tier(F.col("defect") * 100, [("HIGH", "gt", 36), ("MEDIUM", "gt", 34)]).alias("defect_tier")
    )
    df = read(spark, d, "supplier").join(t, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return df.select("s_suppkey", "otd_tier", "defect_tier", features.decision(F.lit(None).cast("string"), [F.col("otd_tier"), F.col("defect_tier")], F.col("l_suppkey").isNull()).alias("risk"))


@query("""SELECT p_partkey, p_size > 20 AND p_brand IN ('Brand#1', 'Brand#2') AND p_retailprice <> 1000 AS matched, true AS decidable FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, false, false FROM part WHERE p_partkey % 2 = 1""")
def rule_records(spark, d):
    size = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("large")
    matched, known = dq.matches(dq.undecided(size, ">", F.lit("20")), dq.undecided(F.col("p_brand"), "IN", ["Brand#1", "Brand#2"]), dq.undecided(F.col("p_retailprice"), "!=", F.lit("1,000")))
    return read(spark, d, "part").select("p_partkey", matched.alias("matched"), known.alias("decidable"))


@query("SELECT CASE WHEN p_size > 20 THEN 'PASSED' ELSE 'FAILED' END AS status, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 UNION ALL SELECT 'UNDECIDABLE', count(*) FROM part WHERE p_partkey % 2 = 1")
def rule_dry_run(spark, d):
    size = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("large")
    matched, known = dq.matches(dq.undecided(size, ">", F.lit(20)))
    status = F.when(~known, "UNDECIDABLE").when(matched, "PASSED").otherwise("FAILED")
    return read(spark, d, "part").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
