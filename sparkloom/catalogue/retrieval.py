"""Recall: weighted terms, routes, vector candidates, searches, pages, hits that may be shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import retrieval as R
from sparkloom.operators import vectors
from sparkloom.sources.tables import read

from . import Registry

query = Registry()

TERMS = [("K1", "red", 3), ("K1", "Widgets", 4), ("K2", "BlueBolt", 3), ("K3", "small ring", 4), ("K3", "ring", 3), ("K4", "x", 9), ("K5", "large_gear", 3)]
HITS = """h AS (SELECT p_partkey, p_name, unnest([
 CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])reds?([^0-9a-z]|$)') THEN {'code': 'K1', 'weight': 3} END, CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])widgetss?([^0-9a-z]|$)') THEN {'code': 'K1', 'weight': 4} END,
 CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])blue([^0-9a-z]|$)') AND regexp_matches(p_name, '(^|[^0-9a-z])bolt([^0-9a-z]|$)') THEN {'code': 'K2', 'weight': 2} END,
 CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])small rings?([^0-9a-z]|$)') THEN {'code': 'K3', 'weight': 4} END, CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])rings?([^0-9a-z]|$)') THEN {'code': 'K3', 'weight': 3} END,
 CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])large([^0-9a-z]|$)') AND regexp_matches(p_name, '(^|[^0-9a-z])gear([^0-9a-z]|$)') THEN {'code': 'K5', 'weight': 2} END]) AS m FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN replace(p_name, 'widget', 'widgets') ELSE p_name END AS p_name FROM part)),
g AS (SELECT p_partkey, m.code AS code, CAST(sum(m.weight) AS BIGINT) AS score FROM h WHERE m IS NOT NULL GROUP BY 1, 2)"""


def _texts(spark, d):
    return read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.replace("p_name", F.lit("widget"), F.lit("widgets"))).otherwise(F.col("p_name")).alias("p_name"))


@query(f"WITH {HITS} SELECT p_partkey, code, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS rn FROM g")
def match_terms(spark, d):
    return R.term_scores(_texts(spark, d), "p_partkey", "p_name", spark.createDataFrame(TERMS, "code string, term string, weight int"))


@query(f"""WITH {HITS}, a AS (SELECT p_partkey, code AS item, score, 0 AS o FROM g UNION ALL SELECT p_partkey, 'K' || (p_size % 6), p_size, 1 FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, item ORDER BY o, score DESC) AS k FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY o, score DESC, item) AS rn FROM f WHERE k = 1)
SELECT p_partkey, CASE o WHEN 0 THEN 'terms' ELSE 'sizes' END AS route, item, score, rn FROM r WHERE rn <= 2""")
def match_routes(spark, d):
    terms = R.term_scores(_texts(spark, d), "p_partkey", "p_name", spark.createDataFrame(TERMS, "code string, term string, weight int")).select("p_partkey", F.col("code").alias("item"), "score")
    sizes = read(spark, d, "part").select("p_partkey", F.concat(F.lit("K"), F.col("p_size") % 6).alias("item"), F.col("p_size").cast("long").alias("score"))
    return R.routed([("terms", terms), ("sizes", sizes)], "p_partkey", 2)


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, e.vec_id % 2 AS side, e.label, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 4) AS distance
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY distance, vec_id) AS rn FROM p)
SELECT query_id, 'K' || label AS code, min(distance) AS distance FROM t WHERE rn <= 5 AND distance <= 8 GROUP BY 1, 2""")
def vec_candidates(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0")
    hits = [vectors.top_k(e.filter(f"vec_id % 2 = {s}"), asked, 5, places=4).select("query_id", F.col("vec_id").alias("item"), "distance") for s in (0, 1)]
    return R.vector_candidates(hits, e.select(F.col("vec_id").alias("item"), F.concat(F.lit("K"), "label").alias("code")), "query_id", 8.0)


@query("SELECT c_custkey, c_name, c_custkey = 17 AS exact FROM customer WHERE c_name ILIKE '%17%' OR c_mktsegment ILIKE '%17%' OR c_custkey = 17 ORDER BY exact DESC, c_custkey LIMIT 5")
def search_exact_first(spark, d):
    return R.search(read(spark, d, "customer"), "17", ["c_name", "c_mktsegment"], "c_custkey").select("c_custkey", "c_name", "exact").limit(5)


@query("""SELECT 'page' AS part, s_suppkey AS k FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 7 OFFSET 3) UNION ALL SELECT 'total', count(*) FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT 'after', s_suppkey FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey > 5 ORDER BY 1 LIMIT 3) UNION ALL SELECT 'before', s_suppkey FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey < 8 ORDER BY 1 DESC LIMIT 3)
UNION ALL SELECT 'head', s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 5) UNION ALL SELECT 'tail', s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY 1 DESC LIMIT 5)""")
def pages_of_rows(spark, d):
    s = read(spark, d, "supplier")
    rows, total = R.page(s.filter("s_acctbal > 0"), [F.col("s_acctbal"), F.col("s_suppkey")], 3, 7)
    named = lambda df, n: df.select(F.lit(n).alias("part"), F.col("s_suppkey").alias("k"))
    out = named(rows, "page").unionByName(total.select(F.lit("total").alias("part"), F.col("total").alias("k")))
    out = out.unionByName(named(R.after(s, "s_suppkey", 5, 3), "after")).unionByName(named(R.before(s, "s_suppkey", 8, 3), "before"))
    return out.unionByName(R.head_and_tail(s.select("s_suppkey"), [F.col("s_suppkey")]).select("part", F.col("s_suppkey").alias("k")))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status, o_orderpriority AS kind, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderdate AS DATE) END AS eff FROM orders WHERE o_orderkey % 10 <> 7)
SELECT l_orderkey AS document_id, count(*) AS hits FROM lineitem JOIN c ON l_orderkey = id WHERE status = 'ACTIVE' AND kind IN ('1-URGENT', '5-LOW') AND (eff IS NULL OR eff <= DATE '1999-01-01')
 AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY 1""")
def hits_shown(spark, d):
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("ACTIVE")
    catalogue = o.filter("o_orderkey % 10 <> 7").select(F.col("o_orderkey").alias("document_id"), status.alias("status"), F.col("o_orderpriority").alias("document_type"), F.when(F.col("o_orderkey") % 6 > 0, F.to_date("o_orderdate")).alias("effective_date"))
    relations = o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("segment:"), "c_mktsegment").alias("entity"))
    hits = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    kept = R.kept_hits(hits, catalogue, relations, ["1-Urgent", "5-low"], ["SEGMENT:building", "segment:MACHINERY"], "1999-01-01")
    return kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""WITH n AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS s FROM events) SELECT event_id FROM n WHERE s IS NULL OR s % 3 = 1""")
def rows_owned(spark, d):
    rows = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("session_id"))
    sessions = read(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("user_id") % 3).alias("owner")).distinct()
    return R.owned(rows, sessions, 1).select("event_id")


@query("""WITH s AS (SELECT c_nationkey AS k, 'N' || (c_custkey % 4) AS name, 0.9 AS score, 'name' AS reason FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_nationkey, 'N' || (c_custkey % 7), 0.55, 'fuzzy' FROM customer WHERE c_acctbal < 1000 UNION ALL SELECT c_nationkey, 'N' || (c_custkey % 5), 0.85, 'table' FROM customer WHERE c_acctbal BETWEEN 4000 AND 4500),
d AS (SELECT DISTINCT * FROM s), g AS (SELECT k, name, max(score) AS score, string_agg(reason, ',' ORDER BY score DESC) AS reasons FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, name) AS rn FROM g) SELECT k, name, CAST(score AS DOUBLE) AS score, reasons, rn FROM r WHERE rn <= 5""")
def source_suggestions(spark, d):
    c = read(spark, d, "customer")

    def signal(where, n, score, reason):
        return c.filter(where).select(F.col("c_nationkey").alias("k"), F.concat(F.lit("N"), F.col("c_custkey") % n).alias("name"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    rows = signal("c_acctbal > 9000", 4, 0.9, "name").unionByName(signal("c_acctbal < 1000", 7, 0.55, "fuzzy")).unionByName(signal("c_acctbal between 4000 and 4500", 5, 0.85, "table"))
    return R.suggestions(rows, "k")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR p_brand IN (SELECT p_brand FROM part WHERE p_size > 45)")
def classes_in_source(spark, d):
    part = read(spark, d, "part")
    classes = part.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 3 != 0, F.upper("p_brand")).alias("table"))
    return R.in_source(classes, part.filter("p_size > 45").select(F.col("p_brand").alias("table"))).select(F.col("name").alias("p_partkey"))
