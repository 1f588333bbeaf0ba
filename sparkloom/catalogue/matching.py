"""Matching, access, retention, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import matching as M
from sparkloom.sources.tables import read
from sparkloom.streaming import streams as S

from . import Registry

query = Registry()

PHRASES = [("red", "K1"), ("blue", "K2"), ("widget", "K3"), ("ring", "K4"), ("bolt", "K5"), ("small", "K6"), ("large", "K7")]
VALUES = ", ".join(f"('{p}', '{c}')" for p, c in PHRASES)


@query(f"""WITH p AS (SELECT * FROM (VALUES {VALUES}) v(phrase, code)), h AS (SELECT p_partkey, phrase, code, length(phrase) AS n, max(length(phrase)) OVER (PARTITION BY p_partkey) AS m FROM part JOIN p ON contains(lower(p_name), phrase))
SELECT p_partkey, min(phrase) AS phrase, arg_min(code, phrase) AS code, count(DISTINCT code) > 1 AS ambiguous FROM h WHERE n = m GROUP BY 1""")
def match_longest_phrase(spark, d):
    return M.longest_phrase(read(spark, d, "part"), "p_partkey", "p_name", spark.createDataFrame(PHRASES, "phrase string, code string"))


@query("""WITH c AS (SELECT * FROM (VALUES ('K1', ['red', 'widget'], 0.5), ('K2', ['small', 'ring', 'bolt'], 0.3)) v(code, keywords, threshold)), w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part)
SELECT p_partkey, code, round(len(list_intersect(w, keywords)) / CAST(len(w) + len(keywords) - len(list_intersect(w, keywords)) AS DOUBLE), 4) AS confidence FROM w, c WHERE len(list_intersect(w, keywords)) / CAST(len(w) + len(keywords) - len(list_intersect(w, keywords)) AS DOUBLE) >= threshold""")
def match_keyword_jaccard(spark, d):
    catalogue = spark.createDataFrame([("K1", ["red", "widget"], 0.5), ("K2", ["small", "ring", "bolt"], 0.3)], "code string, keywords array<string>, threshold double")
    return M.keyword_match(read(spark, d, "part"), "p_partkey", F.split("p_name", " "), catalogue)


@query("""SELECT * FROM (VALUES ('7', 'CODE', 7, 1), ('Supplier#000000003', 'NAME', 3, 1), ('r#000000004', 'PART', 4, 1), ('Supplier#00000000', 'AMBIGUOUS', NULL, 10), ('nobody', 'UNKNOWN', NULL, 0)) v(input, how, code, candidates)""")
def match_resolve_names(spark, d):
    names = spark.createDataFrame([(x,) for x in ("7", "Supplier#000000003", "r#000000004", "Supplier#00000000", "nobody")], "input string")
    return M.resolve(names, read(spark, d, "supplier"), "s_suppkey", "s_name")


@query("""WITH roles AS (SELECT * FROM (VALUES ('en', ['L0', 'L1', 'L2', 'L3']), ('fr', ['L0', 'L1', 'L2']), ('de', ['L0', 'L1'])) v(lang, levels))
SELECT lang, count(*) AS docs FROM documents JOIN roles USING (lang) WHERE list_contains(levels, 'L' || (doc_id % 4)) GROUP BY 1""")
def doc_clearance(spark, d):
    role = F.when(F.col("lang") == "en", "compliance").when(F.col("lang") == "fr", "restricted").otherwise("staff")
    docs = read(spark, d, "documents").filter(F.col("lang").isin("en", "fr", "de"))
    return docs.filter(F.array_contains(M.clearance(role), F.concat(F.lit("L"), F.col("doc_id") % 4))).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT event_id FROM events WHERE NOT (user_id % 10 = 0 AND ts < TIMESTAMP '2024-01-10')")
def retention_delete(spark, d):
    events = read(spark, d, "events")
    closed = events.filter("user_id % 10 = 0").select("user_id").distinct()
    old = events.filter("ts < timestamp'2024-01-10'").join(closed, "user_id", "left_semi").select("event_id")
    return events.join(old, "event_id", "left_anti").select("event_id")


@query("SELECT o_orderkey, nullif(o_custkey % 5, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM orders WHERE nullif(o_custkey % 5, 0) IS NULL OR nullif(o_orderkey % 7, 0) IS NULL")
def id_reconciliation(spark, d):
    ids = read(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("a"), F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("b"))
    return ids.filter("a is null or b is null")


@query("""SELECT x.table_name AS "table", y.table_name AS other, substr(x.column_name, instr(x.column_name, '_') + 1) AS key FROM information_schema.columns x JOIN information_schema.columns y ON substr(x.column_name, instr(x.column_name, '_') + 1) = substr(y.column_name, instr(y.column_name, '_') + 1) AND y.ordinal_position = 1 AND x.table_name <> y.table_name
WHERE x.table_name IN ('orders', 'customer', 'supplier', 'part', 'nation', 'region') AND y.table_name IN ('orders', 'customer', 'supplier', 'part', 'nation', 'region')""")
def join_inference(spark, d):
    frames = {t: read(spark, d, t) for t in ("orders", "customer", "supplier", "part", "nation", "region")}
    return spark.createDataFrame(M.shared_keys(frames), "table string, other string, key string")


@query("SELECT lower(trim(text)) AS question, count(*) AS hits, min(conv_id) AS first_seen FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def question_promotion(spark, d):
    """Repeated questions, each its whole text."""
    q = read(spark, d, "conversations").filter("role = 'user' and text is not null").groupBy(F.lower(F.trim("text")).alias("question"))
    return q.agg(F.count(F.lit(1)).alias("hits"), F.min("conv_id").alias("first_seen")).filter("hits >= 2")


@query("SELECT event_id AS schedule_id, ts AS next_run FROM events WHERE value > 5 AND ts <= TIMESTAMP '2024-01-05' ORDER BY ts, event_id LIMIT 50")
def schedule_due(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("schedule_id"), F.col("ts").alias("next_run"), (F.col("value") > 5).alias("active"))
    return S.due(rows, F.lit("2024-01-05").cast("timestamp")).select("schedule_id", "next_run")


@query("""SELECT w AS "window", event_type, count(*) AS n FROM events JOIN (VALUES ('LAST_7D', TIMESTAMP '2024-01-13'), ('LAST_RUN', TIMESTAMP '2024-01-18 12:00:00')) v(w, start) ON ts >= start AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def report_windows(spark, d):
    windows = spark.createDataFrame([("LAST_7D", "2024-01-13"), ("LAST_RUN", "2024-01-18 12:00:00")], "window string, start string").withColumn("start", F.to_timestamp("start"))
    rows = read(spark, d, "events").filter("ts <= timestamp'2024-01-20'").join(F.broadcast(windows), F.col("ts") >= F.col("start"))
    return rows.groupBy("window", "event_type").agg(F.count(F.lit(1)).alias("n"))
