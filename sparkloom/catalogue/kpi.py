"""KPI tiers, execution, guarded metrics, layers of definitions, slices of a model, time phrases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sparkloom.semantic import kpi, timephrases as T
from sparkloom.semantic.model import Measure, Metric, compute, star
from sparkloom.sources.tables import read

from . import Registry

query = Registry()
TODAY = date(2001, 7, 15)


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AS switch_on, o_orderkey % 7 <> 0 AS kpi_found, o_custkey % 13 <> 0 AS metric_present,
 CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN ' compiled ' WHEN 3 THEN 'ESCAPE_HATCH' ELSE 'other' END AS s, o_orderkey % 3 <> 0 AS ds, o_orderpriority LIKE '1%' AS t, o_orderkey % 2 = 0 AS ready, o_custkey % 3 <> 0 AS f, o_orderkey % 5 <> 0 AS e FROM orders),
x AS (SELECT CASE WHEN NOT switch_on THEN 'LEGACY/TIER_A_DISABLED' WHEN NOT kpi_found THEN 'LEGACY/KPI_NOT_FOUND' WHEN NOT metric_present THEN 'C/METRIC_MISSING' WHEN s = '' THEN 'C/EXECUTION_SOURCE_MISSING' WHEN s = 'none' THEN 'C/EXECUTION_SOURCE_NONE'
 WHEN s = 'other' THEN 'C/EXECUTION_SOURCE_UNKNOWN' WHEN NOT ds THEN 'C/DATASOURCE_MISSING' WHEN t AND NOT ready THEN 'B/EXPLICIT_TIME_SCOPE' WHEN NOT f THEN 'B/FORMULA_EMPTY' WHEN NOT e THEN 'B/RECONCILE_NOT_ELIGIBLE' ELSE 'A/' END AS r FROM k)
SELECT split_part(r, '/', 1) AS tier, nullif(split_part(r, '/', 2), '') AS reason, count(*) AS n FROM x GROUP BY 1, 2""")
def kpi_tiers(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    source = F.when(c % 5 == 0, "").when(c % 5 == 1, "none").when(c % 5 == 2, " compiled ").when(c % 5 == 3, "ESCAPE_HATCH").otherwise("other")
    rows = read(spark, d, "orders").select(
        (o % 11 != 0).alias("switch_on"), (o % 7 != 0).alias("kpi_found"), (c % 13 != 0).alias("metric_present"), source.alias("execution_source"), (o % 3 != 0).alias("has_datasource"),
        F.col("o_orderpriority").startswith("1").alias("explicit_time"), (o % 2 == 0).alias("time_ready"), (c % 3 != 0).alias("formula_present"), (o % 5 != 0).alias("eligible"),
    )
    return kpi.tier(rows).groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("n"))


def _revenue(grain=()):
    return Metric("revenue", "MEASURE", Measure("sum", "round(l_extendedprice * (1 - l_discount), 0)"), grain=grain)


@query("""WITH o AS (SELECT l_returnflag AS f FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 1), n AS (SELECT count(DISTINCT l_returnflag) AS k FROM lineitem)
SELECT true AS ok, f AS value, least(k, 2) AS row_count, k > 2 AS truncated, CAST(NULL AS VARCHAR) AS reason FROM o, n UNION ALL SELECT false, NULL, 0, false, 'EMPTY_RESULT' UNION ALL SELECT false, NULL, 0, false, 'EXECUTION_ERROR: AnalysisException'""")
def kpi_execution(spark, d):
    catalog = star(spark, d)
    metric, _ = kpi.guarded(_revenue(("l_returnflag",)), [kpi.Source("line", "BASE")])
    good = kpi.execute(compute(catalog, metric).orderBy("l_returnflag"), 2)
    empty = kpi.execute(read(spark, d, "lineitem").filter("l_quantity < 0"))
    try:
        bad = kpi.execute(read(spark, d, "lineitem").select("no_such_column"))
    except Exception as e:
        bad = spark.createDataFrame([(False, None, 0, False, f"EXECUTION_ERROR: {type(e).__name__}")], good.schema)
    return good.unionByName(empty).unionByName(bad)


@query("""WITH a AS (SELECT c_mktsegment, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), b AS (SELECT c_mktsegment, sum(c_acctbal) AS t FROM customer GROUP BY 1)
SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, round(a.t / nullif(b.t, 0), 6) AS spend_ratio FROM a FULL OUTER JOIN b ON a.c_mktsegment = b.c_mktsegment""")
def kpi_ratio_of_sides(spark, d):
    """A ratio over 1:N tables: each side is summed on its own, so a customer's balance counts once."""
    metric = Metric("spend_ratio", "RATIO", Measure("sum", "o_totalprice"), Measure("sum", "c_acctbal"), grain=("c_mktsegment",))
    metric, _ = kpi.guarded(metric, [kpi.Source("order", "NUMERATOR"), kpi.Source("customer", "DENOMINATOR")])
    return kpi.by_sides(star(spark, d), metric).withColumn("spend_ratio", F.round("spend_ratio", 6))


@query("""WITH g AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_size > 10), t AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_partkey % 3 = 0 AND p_size < 30), e AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_partkey % 9 = 0),
x AS (SELECT code FROM g UNION SELECT code FROM t UNION SELECT code FROM e), y AS (SELECT code, code IN (SELECT code FROM g) AS in_governed, code IN (SELECT code FROM t) AS in_technical, code IN (SELECT code FROM e) AS in_executable FROM x)
SELECT *, CASE WHEN in_governed AND in_technical AND in_executable THEN 'ALIGNED' WHEN in_governed AND NOT in_technical THEN 'NOT_MODELLED' WHEN NOT in_governed THEN 'NOT_GOVERNED' ELSE 'NOT_EXECUTABLE' END AS status FROM y""")
def kpi_reconcile(spark, d):
    part = read(spark, d, "part").withColumn("code", F.col("p_brand"))
    return kpi.reconcile(part.filter("p_size > 10"), part.filter("p_partkey % 3 = 0 and p_size < 30"), part.filter("p_partkey % 9 = 0"))


CLASSES = """c AS (SELECT 'S' || s_suppkey AS name, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL FROM region),
j AS (SELECT DISTINCT 'S' || a.s_suppkey AS source, 'N' || b.n_nationkey AS target FROM supplier a JOIN nation b ON a.s_nationkey % 5 = b.n_nationkey % 5)"""


def _model(spark, d):
    s, n, r = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    classes = s.select(name("S", "s_suppkey").alias("name"), name("N", "s_nationkey").alias("parent"))
    classes = classes.unionByName(n.select(name("N", "n_nationkey").alias("name"), name("R", "n_regionkey").alias("parent")))
    classes = classes.unionByName(r.select(name("R", "r_regionkey").alias("name"), F.lit(None).cast("string").alias("parent")))
    joins = s.join(n, F.col("s_nationkey") % 5 == F.col("n_nationkey") % 5).select(name("S", "s_suppkey").alias("source"), name("N", "n_nationkey").alias("target")).distinct()
    return classes, joins, s.filter("s_suppkey % 4 = 1").select(name("S", "s_suppkey").alias("name"))


@query(f"""WITH RECURSIVE {CLASSES}, z AS (SELECT name, parent FROM c WHERE name IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 1) UNION SELECT c.name, c.parent FROM c JOIN z ON c.name = z.parent)
SELECT 'class' AS kind, name AS a, CAST(NULL AS VARCHAR) AS b FROM (SELECT DISTINCT name FROM z) UNION ALL SELECT 'join', source, target FROM j WHERE source IN (SELECT name FROM z) AND target IN (SELECT name FROM z)""")
def model_slice(spark, d):
    names, inside = kpi.domain_slice(*_model(spark, d))
    rows = names.select(F.lit("class").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"))
    return rows.unionByName(inside.select(F.lit("join").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("""SELECT 'duplicate' AS problem, lower(p_name) AS item, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT CASE WHEN p_size > 30 THEN 'TABLE_MISSING' ELSE 'COLUMN_MISSING' END, p_brand, count(*) FROM part WHERE p_size > 30 OR (p_size <= 30 AND p_size > 20) GROUP BY 1, 2""")
def model_checks(spark, d):
    part = read(spark, d, "part")
    twice = kpi.duplicates(part.select(F.lit("parts").alias("section"), F.col("p_name").alias("name"))).select(F.lit("duplicate").alias("problem"), F.col("name").alias("item"), "n")
    bindings = part.select(F.when(F.col("p_size") > 30, "Lost").otherwise("Part").alias("table"), F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("P_SIZE").alias("column"))
    physical = spark.createDataFrame([("part", c) for c in part.columns], "table string, column string")
    lost = kpi.landing_gaps(bindings, physical).groupBy("problem", F.col("column").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return twice.unionByName(lost.filter("problem <> 'COLUMN_MISSING' or item <> 'P_SIZE'"))


@query("""WITH t AS (SELECT o_orderkey % 9 AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN k IN (0) THEN 'BOOLEAN' WHEN k IN (1, 2) THEN 'INT' WHEN k IN (3, 4) THEN 'DECIMAL' WHEN k IN (5, 6) THEN 'DATETIME' ELSE 'STRING' END AS logical, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1""")
def model_types(spark, d):
    names = ["tinyint(1)", "NUMBER(10,0)", "bigint", "number", "decimal(12,2)", "timestamp(6)", "DATE", "varchar2(20)", "interval"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return read(spark, d, "orders").groupBy(kpi.logical_type(kind).alias("logical")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' AND (o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2000-10-01') GROUP BY 1
UNION ALL SELECT 'recent', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderdate < TIMESTAMP '2001-08-01'
UNION ALL SELECT 'half', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2001-01-01'""")
def time_placeholder(spark, d):
    orders = read(spark, d, "orders")
    total = F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    rows = orders.filter(T.fill("o_orderstatus <> 'P' and {time_scope}", "2000年第三季度的订单", "o_orderdate", TODAY)).groupBy("o_orderstatus").agg(*total)
    for name, question in (("recent", "近三个月"), ("half", "去年下半年")):
        rows = rows.unionByName(orders.filter(T.fill("{time_scope}", question, "o_orderdate", TODAY)).agg(*total).withColumn("o_orderstatus", F.lit(name)))
    return rows


@query("""SELECT p_partkey, least(p_size * 50, 1000) AS n, p_partkey % 3 = 1 AS extreme, p_partkey % 3 = 2 OR p_size * 50 BETWEEN 1900 AND 2099 AS timed FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL, false, false FROM part WHERE p_partkey % 3 = 0""")
def phrase_flags(spark, d):
    k = F.col("p_partkey") % 3
    n = (F.col("p_size") * 50).cast("string")
    text = F.when(k == 1, F.concat(F.lit("Highest price, TOP "), n, F.lit(" parts"))).when(k == 2, F.concat(F.lit("去年 前"), n, F.lit(" 个"))).otherwise("all parts")
    rows = read(spark, d, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", T.top_n(F.col("t")).alias("n"), T.superlative(F.col("t")).alias("extreme"), T.has_time(F.col("t")).alias("timed"))


@query("""SELECT p_partkey, u.i AS step_no, CASE u.i WHEN 1 THEN 'for ' || p_brand || ' sum ' || p_size ELSE 'rank ' || p_name END AS step FROM part, (SELECT unnest([1, 2]) AS i) u WHERE p_size > 10 UNION ALL SELECT p_partkey, 1, 'list ' || p_name FROM part WHERE p_size <= 10""")
def question_steps(spark, d):
    long = F.concat(F.lit("for "), "p_brand", F.lit("，首先 sum "), "p_size", F.lit("；然后 rank "), "p_name", F.lit("。"))
    rows = read(spark, d, "part").select("p_partkey", T.steps(F.when(F.col("p_size") > 10, long).otherwise(F.concat(F.lit("list "), "p_name"))).alias("s"))
    return rows.select("p_partkey", F.posexplode("s").alias("i", "step")).select("p_partkey", (F.col("i") + 1).alias("step_no"), "step")


@query("""SELECT table_name AS "table", count(*) AS columns FROM information_schema.columns WHERE table_name IN ('lineitem', 'orders', 'customer', 'supplier', 'part', 'nation', 'region') GROUP BY 1""")
def model_tables(spark, d):
    """What an agent's tool lists of the model: its physical tables and their columns."""
    catalog = star(spark, d)
    rows = [(t.source, f.name, f.dataType.simpleString()) for t in catalog.tables.values() for f in catalog.frame(t.name).schema]
    return spark.createDataFrame(rows, "table string, column string, type string").groupBy("table").agg(F.count(F.lit(1)).alias("columns"))
