"""Keeping tables in step, joins and aggregates of the warehouse that need a form of their own, charts and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import charts as C
from sparkloom.operators import dq
from sparkloom.semantic.model import ratio
from sparkloom.sources import shared, sync as S
from sparkloom.sources.tables import read

from . import Registry

query = Registry()


@query("""WITH m AS (SELECT c_mktsegment AS code, arg_min(c_name || ' ' || c_nationkey, c_custkey) AS name FROM customer GROUP BY 1) SELECT 'SEGMENT' AS entity_type, code, name, substr(sha256('SEGMENT|' || code), 1, 16) AS key FROM m""")
def sync_master(spark, d):
    return S.master_data(read(spark, d, "customer"), "SEGMENT", "c_mktsegment", ["c_name", "c_nationkey"], "c_custkey")


@query("""SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, upper(n_name), -1 FROM nation WHERE n_nationkey >= 20 AND n_nationkey % 2 = 0""")
def sync_rename(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    new = n.filter("key % 2 = 0").select("key", F.upper("name").alias("name"), F.lit(-1).alias("region"))
    return S.renamed(n.filter("key < 20"), new)


@query("""WITH s AS (SELECT DISTINCT o_custkey % 50 AS k, o_orderstatus AS v, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 1 AS INT) AS b FROM orders WHERE o_orderkey % 97 = 3), m AS (SELECT k, count(*) AS n FROM s GROUP BY 1), t AS (SELECT k, v, a, b FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY v, a, b) = 1 AND k % 3 = 0)
SELECT s.k, CASE WHEN s.a > s.b OR n > 1 THEN 'failed' WHEN t.k IS NULL THEN 'inserted' ELSE 'skipped' END AS status, CASE WHEN s.a > s.b THEN 'DATE_RANGE' WHEN n > 1 THEN 'CONFLICT' END AS reason, '' AS changed FROM s JOIN m USING (k) LEFT JOIN t USING (k)""")
def sync_checked(spark, d):
    o = read(spark, d, "orders").filter("o_orderkey % 97 = 3")
    day = F.to_date("o_orderdate")
    rows = o.select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderstatus").alias("v"), day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 9 - 1).cast("int")).alias("b"))
    target = rows.filter("k % 3 = 0").groupBy("k").agg(F.min(F.struct("v", "a", "b")).alias("x")).select("k", "x.*")
    return S.checked(target, rows, ["k"], ["v", "a", "b"], "a", "b")


@query("""WITH e AS (SELECT user_id, ts, value, CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' END AS a FROM events), w AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, a) AS valid_to FROM e WHERE a IS NOT NULL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, a) AS INT) AS version, a AS action, ts AS valid_from, valid_to, value FROM w WHERE a <> 'DELETE'""")
def sync_history(spark, d):
    kind = F.col("event_type")
    rows = read(spark, d, "events").withColumn("action", F.when(kind == "view", "CREATE").when(kind == "click", "UPDATE").when(kind == "error", "DELETE"))
    return S.history(rows, "user_id", "ts", "action", ["value"])


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events WHERE event_id % 3 <> 1 GROUP BY 1")
def sync_versions(spark, d):
    """Two loads of a versioned table, the second by a new handle, as after a restart; the first load repeated changes nothing."""
    rows = read(spark, d, "events").select("user_id", "ts", "event_id")
    root, schema = shared.path(spark, "versions"), "user_id long, ts timestamp, event_id long"
    S.upsert(S.Versions(spark, root, schema), rows.filter("event_id % 3 = 0"), ["user_id"], "ts", 0)
    again = S.Versions(spark, root, schema)
    S.upsert(again, rows.filter("event_id % 3 = 2"), ["user_id"], "ts", 1)
    S.upsert(again, rows.filter("event_id % 3 = 1"), ["user_id"], "ts", 0)
    return again.read()


@query("""WITH n AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey % 50 AS b FROM lineitem) SELECT a, b, 'r2' AS release_id FROM e WHERE a IN (SELECT s_suppkey FROM n) AND b IN (SELECT s_suppkey FROM n)""")
def graph_release(spark, d):
    nodes = read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 50).alias("b"))
    return S.graph_release(nodes, edges, "r2")[1]


@query("""WITH r AS (SELECT n_regionkey AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn, n_name, n_nationkey FROM nation)
SELECT sheet, CAST(rn + 1 AS INT) AS line_no, '| ' || replace(n_name, '|', ' ') || ' | ' || n_nationkey || ' |' AS line FROM r WHERE rn <= 3 UNION ALL SELECT DISTINCT n_regionkey, 0, '| n_name | n_nationkey |' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 1, '| --- | --- |' FROM nation""")
def sheet_lines(spark, d):
    return S.sheet_markdown(read(spark, d, "nation").withColumnRenamed("n_regionkey", "sheet"), "sheet", "n_nationkey", ["n_name", "n_nationkey"], 3)


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS active, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F' OR o_totalprice < 1000) AS stale, count(DISTINCT o_custkey) AS every FROM orders GROUP BY 1")
def agg_filtered_distinct(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "O").alias("a"), ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 1000)).alias("s"))
    # one row for each customer and group before they are counted: no row is expanded for each distinct count
    once = o.groupBy("o_orderpriority", "o_custkey").agg(F.bool_or("a").alias("a"), F.bool_or("s").alias("s"))
    return once.groupBy("o_orderpriority").agg(F.count_if("a").alias("active"), F.count_if("s").alias("stale"), F.count(F.lit(1)).alias("every"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q, CASE WHEN l_partkey % 7 = 0 THEN l_extendedprice * 1.1 ELSE l_extendedprice END AS p FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
SELECT l.l_suppkey, count(*) AS lines, count(*) FILTER (WHERE q = l_quantity AND p = l_extendedprice) AS matched, round(count(*) FILTER (WHERE q = l_quantity AND p = l_extendedprice) / CAST(count(*) AS DOUBLE), 4) AS rate FROM l JOIN i USING (l_orderkey, l_linenumber) GROUP BY 1""")
def join_three_way(spark, d):
    """Order lines and invoices on their keys; that quantity and price agree too is counted, not joined on."""
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(order).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    q = F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    p = F.when(F.col("l_partkey") % 7 == 0, F.col("l_extendedprice") * 1.1).otherwise(F.col("l_extendedprice"))
    invoices = lines.select("l_orderkey", "l_linenumber", q.alias("q"), p.alias("p"))
    same = (F.col("q") == F.col("l_quantity")) & (F.col("p") == F.col("l_extendedprice"))
    g = lines.join(invoices, ["l_orderkey", "l_linenumber"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(same).alias("matched"))
    return g.withColumn("rate", F.round(ratio(F.col("matched"), F.col("lines")), 4))


@query("""WITH a AS (SELECT l_suppkey AS s, strftime(l_shipdate, '%Y-%m') AS m, count(*) AS lines FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS s, strftime(l_shipdate, '%Y-%m') AS m, l_partkey % 4 AS g, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)
SELECT s, count(*) AS rows, CAST(sum(lines) AS BIGINT) AS lines, round(sum(q), 2) AS q FROM a JOIN b USING (s, m) GROUP BY 1""")
def join_monthly_facts(spark, d):
    """Two monthly facts of different grain: the coarser one's rows repeat for each row of the finer, and are summed as often."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.date_format("l_shipdate", "yyyy-MM").alias("m"), (F.col("l_partkey") % 4).alias("g"), "l_quantity")
    a, b = rows.groupBy("s", "m").agg(F.count(F.lit(1)).alias("lines")), rows.groupBy("s", "m", "g").agg(F.sum("l_quantity").alias("q"))
    return a.join(b, ["s", "m"]).groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.sum("lines").alias("lines"), F.round(F.sum("q"), 2).alias("q"))


@query("""SELECT 'fine' AS code, 'VALIDITY' AS kind, 'orders' AS table_name, 50.0::DOUBLE AS threshold, count(*) FILTER (WHERE o_totalprice > 0) AS passed, count(*) AS total, round(count(*) FILTER (WHERE o_totalprice > 0) / CAST(count(*) AS DOUBLE) * 100, 4) AS pass_rate, CASE WHEN count(*) FILTER (WHERE o_totalprice > 0) * 2 >= count(*) THEN 'PASS' ELSE 'FAIL' END AS status FROM orders
UNION ALL SELECT code, kind, t, 100.0, 0, 0, 0.0, 'ERROR' FROM (VALUES ('no column', 'COMPLETENESS', 'orders'), ('no condition', 'VALIDITY', 'orders'), ('no table', 'UNIQUENESS', 'lost'), ('no sense', 'CONSISTENCY', 'orders'), ('late', 'TIMELINESS', 'orders')) v(code, kind, t)""")
def dq_errors(spark, d):
    rules = [
        dq.Rule("fine", "VALIDITY", "orders", expression="o_totalprice > 0", threshold=50), dq.Rule("no column", "COMPLETENESS", "orders", "nothing"), dq.Rule("no condition", "VALIDITY", "orders", expression="o_totalprice + 1"),
        dq.Rule("no table", "UNIQUENESS", "lost", "x"), dq.Rule("no sense", "CONSISTENCY", "orders", expression="o_totalprice >"), dq.Rule("late", "TIMELINESS", "orders", "o_orderdate"),
    ]
    return dq.evaluate({"orders": read(spark, d, "orders")}, rules)


@query("""SELECT 'e.id.type' AS code, count(*) FILTER (WHERE regexp_full_match(id, '-?[0-9]+')) AS passed, count(*) AS total FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'x' ELSE '' END || event_id AS id FROM events)
UNION ALL SELECT 'e.amount.type', count(*) FILTER (WHERE amount IS NULL OR regexp_full_match(amount, '-?[0-9]+([.][0-9]+)?')), count(*) FROM (SELECT CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '1e5' ELSE '12.50' END AS amount FROM events)
UNION ALL SELECT 'e.day.type', count(*), count(*) FROM events UNION ALL SELECT 'e.flag.type', count(*) FILTER (WHERE event_type <> 'click'), count(*) FROM events""")
def dq_derive(spark, d):
    k = F.col("event_id")
    df = read(spark, d, "events").select(
        F.concat(F.when(k % 10 == 0, "x").otherwise(""), k.cast("string")).alias("id"), F.when(k % 4 == 1, "1e5").when(k % 4 > 1, "12.50").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), F.when(F.col("event_type") == "click", "yes").otherwise("t").alias("flag"), "user_id",
    )
    rules = dq.derive_types(df, "e", {"id": "INT", "amount": "DECIMAL", "day": "DATETIME", "flag": "BOOLEAN", "user_id": "INT"})
    return dq.evaluate({"e": df}, rules).select("code", "passed", "total")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F' AND x.o_orderdate >= o.o_orderdate)) AS passed FROM orders o")
def dq_dates(spark, d):
    o = read(spark, d, "orders")
    return dq.date_consistency(o, o.filter("o_orderstatus = 'F'"), [("o_custkey", "o_custkey")], "o_orderdate", "o_orderdate")


@query("SELECT CASE WHEN p_size % 4 = 0 THEN 'SET_MEMBERSHIP' WHEN p_size % 4 = 1 THEN 'THRESHOLD' ELSE 'LOOKUP' END AS kind, count(*) AS n FROM part GROUP BY 1")
def rule_kinds(spark, d):
    op = F.element_at(F.array(*map(F.lit, ("not in", " >= ", "=", "!="))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").groupBy(dq.rule_kind(op).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _bit(n):
    return F.floor(F.col("p_partkey") / n) % 2 == 1


@query("""WITH s AS (SELECT p_partkey AS k, p_size % 21 AS row_count, CAST(p_partkey % 3 AS INT) AS measures, CAST(p_partkey // 3 % 3 AS INT) AS dimensions, p_partkey // 9 % 2 = 1 AS has_time, p_partkey // 18 % 2 = 1 AS share_formula, p_partkey // 36 % 2 = 1 AS is_top_n, p_partkey // 72 % 2 = 1 AS ranking, p_partkey // 144 % 2 = 1 AS waterfall, p_partkey // 7 % 2 = 1 AS decomposable, p_partkey // 288 % 2 = 1 AS combo, p_partkey // 5 % 2 = 1 AS raw_detail, p_partkey % 10 / 10.0 AS coverage, p_partkey // 11 % 2 = 1 AS question_share FROM part)
SELECT k, CASE WHEN row_count = 0 OR (measures + dimensions = 0 AND NOT has_time) THEN 'TABLE/R00_EMPTY_TABLE' WHEN row_count = 1 AND measures = 1 AND dimensions <= 1 THEN 'KPI/R01_SINGLE_VALUE_KPI' WHEN row_count = 1 AND measures >= 1 AND (measures >= 2 OR dimensions >= 2) THEN 'TABLE/R01S_SINGLE_ROW_TABLE'
 WHEN share_formula AND measures = 1 AND dimensions = 1 AND row_count <= 6 THEN 'DONUT/R02_SHARE_DONUT' WHEN share_formula AND measures = 1 AND dimensions = 1 THEN 'HBAR/R03_SHARE_OVERFLOW_HBAR' WHEN (is_top_n OR ranking) AND NOT has_time AND dimensions >= 1 AND measures >= 1 THEN 'HBAR/R04_TOPN_HBAR' WHEN ranking AND has_time AND measures >= 1 THEN 'HBAR/R04_TOPN_HBAR'
 WHEN waterfall AND decomposable AND dimensions = 1 AND measures = 1 AND row_count BETWEEN 2 AND 12 THEN 'WATERFALL/R05_WATERFALL' WHEN has_time AND measures >= 2 AND (combo OR share_formula) THEN 'COMBO/R06_COMBO' WHEN has_time AND measures >= 1 THEN 'LINE/R07_TREND_LINE' WHEN measures = 2 AND dimensions <= 1 THEN 'SCATTER/R08_RELATION_SCATTER'
 WHEN raw_detail AND dimensions >= 2 THEN 'TABLE/R13_RAW_DETAIL_TABLE' WHEN dimensions = 2 AND measures = 1 AND coverage >= 0.6 THEN 'HEATMAP/R09_MULTIDIM_HEATMAP' WHEN dimensions = 2 AND measures = 1 THEN 'BAR/R10_MULTIDIM_BAR' WHEN dimensions = 1 AND measures >= 1 AND row_count > 15 THEN 'HBAR/R11_HBAR_MANY_ROWS'
 WHEN dimensions = 1 AND measures >= 1 AND question_share AND row_count <= 6 THEN 'DONUT/R12S_QUESTION_SHARE_DONUT' WHEN dimensions = 1 AND measures >= 1 AND question_share THEN 'HBAR/R12S_QUESTION_SHARE_HBAR' WHEN dimensions = 1 AND measures >= 1 THEN 'BAR/R12_CATEGORY_BAR' ELSE 'TABLE/R14_DEFAULT_TABLE' END AS chart FROM s""")
def chart_rules(spark, d):
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(
        k.alias("k"), (F.col("p_size") % 21).cast("long").alias("row_count"), (k % 3).cast("int").alias("measures"), (F.floor(k / 3) % 3).cast("int").alias("dimensions"), _bit(9).alias("has_time"), _bit(18).alias("share_formula"), _bit(36).alias("is_top_n"),
        _bit(72).alias("ranking"), _bit(144).alias("waterfall"), _bit(7).alias("decomposable"), _bit(288).alias("combo"), _bit(5).alias("raw_detail"), (k % 10 / 10).alias("coverage"), _bit(11).alias("question_share"),
    )
    return C.chart(rows).select("k", F.concat_ws("/", "kind", "rule").alias("chart"))


CLAIMS = [("销售额增长", "increase"), ("成本没有下降", None), ("不应大幅下降，但上升", "increase"), ("无锡下降", "decrease"), ("价格不涨", None), ("先升后降", None), ("增加而后减少", None), ("未来提高", "increase"), ("不是下降", None), ("下滑", "decrease")]
CLAIM_ROWS = ", ".join(f"({i}, {'NULL' if want is None else repr(want)})" for i, (_, want) in enumerate(CLAIMS))


@query(f"SELECT p_partkey, direction FROM part JOIN (VALUES {CLAIM_ROWS}) v(i, direction) ON p_partkey % 10 = i")
def claim_directions(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in CLAIMS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", C.direction(text).alias("direction"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t, min(min(p_size)) OVER (PARTITION BY p_brand) AS lo, max(max(p_size)) OVER (PARTITION BY p_brand) AS hi FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c)
SELECT p_brand, substr('by type: ' || string_agg(p_type || ' ' || printf('%.1f', round(100.0 * n / t, 1)) || '%', ', ' ORDER BY rn) || '; size from ' || printf('%.2f', CAST(any_value(lo) AS DOUBLE)) || ' to ' || printf('%.2f', CAST(any_value(hi) AS DOUBLE)), 1, 200) AS claim FROM r WHERE rn <= 5 GROUP BY 1""")
def claim_texts(spark, d):
    from pyspark.sql import Window

    n = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    w = Window.partitionBy("p_brand")
    n = n.select("*", F.sum("n").over(w).alias("t"), F.row_number().over(w.orderBy(F.desc("n"), "p_type")).alias("rn"), F.min("lo").over(w).alias("low"), F.max("hi").over(w).alias("high"))
    top = F.struct("rn", F.col("p_type").alias("value"), F.round(F.col("n") * 100 / F.col("t"), 1).alias("share"))
    g = n.filter("rn <= 5").groupBy("p_brand").agg(F.array_sort(F.collect_list(top)).alias("tops"), F.first("low").cast("double").alias("low"), F.first("high").cast("double").alias("high"))
    return g.select("p_brand", C.claim(F.lit("type"), F.col("tops"), F.col("low"), F.col("high"), "size", F.lit("")).alias("claim"))
