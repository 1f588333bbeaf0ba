"""Plans: projection, predicates, grouping, ranking, joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sparkloom.plans.query_plan import between, bucket, build, from_dict, named
from sparkloom.plans.steps import narrowed, run_steps
from sparkloom.semantic.model import star
from sparkloom.sources.tables import read

from . import Registry

query = Registry()


def _plan(spark, d, **raw):
    plan, drops = from_dict(raw)
    assert plan is not None and not drops, drops
    return build(star(spark, d), plan)


def agg(alias, function=None, column=None, formula=None):
    return {"alias": alias, "function": function, "column": column, "formula": formula}


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND (l_discount >= 0.05 OR l_tax = 0)")
def plan_project_filter(spark, d):
    return _plan(spark, d, table="line", columns=["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], conditions=["l_quantity > 45", "l_discount >= 0.05 or l_tax = 0"])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def plan_in_list(spark, d):
    return _plan(spark, d, table="order", conditions=["o_orderpriority in ('1-URGENT', '2-HIGH')"], groupBy=["o_orderpriority", "o_orderstatus"], aggregations=[agg("n", "count")])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%#1%'")
def plan_like_ci(spark, d):
    return _plan(spark, d, table="part", columns=["p_partkey", "p_name"], conditions=["p_name ilike '%RING%' or p_brand ilike '%#1%'"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def plan_between_dates(spark, d):
    return _plan(spark, d, table="order", columns=["o_orderkey", "o_totalprice"], conditions=["o_orderdate between timestamp'1997-01-01' and timestamp'1997-03-31'"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND NOT (c_acctbal < 0)")
def plan_exclude(spark, d):
    return _plan(spark, d, table="customer", columns=["c_custkey", "c_mktsegment"], conditions=["c_mktsegment <> 'BUILDING'", "not (c_acctbal < 0)"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def plan_groupby_month(spark, d):
    return _plan(spark, d, table="order", derived={"month": "date_format(o_orderdate, 'yyyy-MM')"}, groupBy=["month"], aggregations=[agg("n", "count"), agg("total", formula="round(sum(o_totalprice), 2)")])


@query("""SELECT c_mktsegment, round(sum(c_acctbal), 2) AS amount, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 6) AS share
FROM customer GROUP BY c_mktsegment""")
def plan_formula_share(spark, d):
    df = _plan(spark, d, table="customer", groupBy=["c_mktsegment"], aggregations=[agg("amount", "sum", "c_acctbal")], shares=[["share", "amount"]])
    return df.select("c_mktsegment", F.round("amount", 2).alias("amount"), F.round("share", 6).alias("share"))


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600")
def plan_having(spark, d):
    return _plan(spark, d, table="line", groupBy=["l_suppkey"], aggregations=[agg("n", "count"), agg("parts", "count_distinct", "l_partkey")], having=["n >= 600"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25")
def plan_topn_global(spark, d):
    return _plan(spark, d, table="order", columns=["o_orderkey", "o_totalprice"], sort=[{"column": "o_totalprice", "order": "desc"}, {"column": "o_orderkey"}], rowLimit="25")


@query("""SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS rn
FROM customer) WHERE rn <= 3""")
def plan_topn_per_group(spark, d):
    return _plan(spark, d, table="customer", columns=["c_mktsegment", "c_custkey", "c_acctbal"], partitionBy=["c_mktsegment"], perGroupLimit=3, sort=[{"column": "c_acctbal", "order": "desc"}, {"column": "c_custkey"}])


@query("""SELECT c_custkey, segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
ORDER BY segment DESC NULLS FIRST, c_custkey LIMIT 40""")
def plan_null_order(spark, d):
    return _plan(spark, d, table="customer", derived={"segment": "nullif(c_mktsegment, 'BUILDING')"}, sort=[{"column": "segment", "order": "desc"}, {"column": "c_custkey"}], rowLimit=40).select("c_custkey", "segment")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def plan_paginate(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").offset(40).limit(20)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def plan_keyset_page(spark, d):
    return read(spark, d, "orders").filter("o_orderkey > 500").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("""SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def plan_join_path_3hop(spark, d):
    return _plan(spark, d, table="order", also=["region"], groupBy=["r_name"], aggregations=[agg("n", "count"), agg("total", formula="round(sum(o_totalprice), 2)")])


@query("""SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R') ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def plan_left_join(spark, d):
    lines = read(spark, d, "lineitem").filter("l_quantity = 50 and l_returnflag = 'R'").select("l_suppkey", "l_orderkey")
    return read(spark, d, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def plan_semi(spark, d):
    big = read(spark, d, "orders").filter("o_totalprice > 450000")
    return read(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def plan_anti(spark, d):
    done = read(spark, d, "orders").filter("o_orderstatus = 'F'")
    return read(spark, d, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) IN (SELECT (o_custkey, max(o_orderkey)) FROM orders GROUP BY o_custkey)""")
def plan_self_max(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) GROUP BY o_orderstatus""")
def plan_correlated_range_exists(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    later = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate"))
    return read(spark, d, "orders").join(lines, later, "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def plan_scalar_subqueries(spark, d):
    customers = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    suppliers = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    df = read(spark, d, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(suppliers, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return df.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""WITH per AS (SELECT l_suppkey AS supplier, avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY 1),
top AS (SELECT supplier, price FROM per ORDER BY price DESC, supplier LIMIT 10)
SELECT s_name, round(price, 4) AS price FROM top JOIN supplier ON supplier = s_suppkey""")
def plan_chained_steps(spark, d):
    tables = {"lines": read(spark, d, "lineitem"), "suppliers": read(spark, d, "supplier")}
    return run_steps(spark, tables, [
        ("per", "select l_suppkey as supplier, avg(l_extendedprice / nullif(l_quantity, 0)) as price from {lines} group by 1"),
        ("top", "select supplier, price from {per} order by price desc, supplier limit 10"),
        ("named", "select s_name, round(price, 4) as price from {top} join {suppliers} on supplier = s_suppkey"),
    ])


@query("""SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_quantity, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running,
dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS day_rank, ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS quarter
FROM lineitem WHERE l_quantity > 40""")
def plan_window_frames(spark, d):
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_suppkey").orderBy(*keys)
    return read(spark, d, "lineitem").filter("l_quantity > 40").select(
        "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity",
        F.round(F.sum("l_quantity").over(w.rowsBetween(-2, 0)), 2).alias("running"),
        F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate")).alias("day_rank"),
        F.ntile(4).over(w).alias("quarter"),
    )


@query("""WITH g AS (SELECT c_mktsegment, date_trunc('quarter', o_orderdate)::DATE AS q, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1, 2)
SELECT c_mktsegment, q, total, round(sum(total) OVER (PARTITION BY c_mktsegment ORDER BY q ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS two, rank() OVER (PARTITION BY q ORDER BY total DESC) AS place, ntile(2) OVER (PARTITION BY c_mktsegment ORDER BY q) AS half FROM g""")
def plan_named_windows(spark, d):
    """Logical names, a time bucket by its word, a range of dates, frames and ranks, all from a plan."""
    catalog = star(spark, d)
    plan, drops = from_dict({
        "table": "order", "also": ["customer"], "derived": {"q": bucket("o_orderdate", "季度")}, "groupBy": ["mktsegment", "q"], "aggregations": [agg("total", "sum", "totalprice")],
        "windows": {"two": "sum(total) over (partition by c_mktsegment order by q rows between 1 preceding and current row)", "place": "rank() over (partition by q order by total desc)", "half": "ntile(2) over (partition by c_mktsegment order by q)"},
    })
    assert not drops
    df = build(catalog, between(named(catalog, plan), "o_orderdate", "1999-01-01", "2000-12-31"))
    return df.select("c_mktsegment", F.col("q").cast("date").alias("q"), F.round("total", 2).alias("total"), F.round("two", 2).alias("two"), "place", "half")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)")
def plan_steps_narrow(spark, d):
    """A second step over what the first one found."""
    best = _plan(spark, d, table="customer", columns=["c_custkey", "c_acctbal"], sort=[{"column": "c_acctbal", "order": "desc"}, {"column": "c_custkey"}], rowLimit=20)
    return narrowed(read(spark, d, "orders"), "o_custkey", best, "c_custkey").select("o_orderkey")
