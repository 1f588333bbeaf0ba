"""Streams over the event log; each result equals a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.sources.tables import read
from sparkloom.streaming import streams as S

from . import Registry

query = Registry()


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return S.drained(S.tumbling(S.source(spark, d, "events", S.EVENTS), "6 hours"), "complete", "tumbling")


@query("""SELECT b - s AS start, b - s + INTERVAL 12 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, unnest([INTERVAL 0 HOUR, INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL""")
def stream_sliding(spark, d):
    return S.drained(S.sliding(S.source(spark, d, "events", S.EVENTS), "12 hours", "6 hours"), "complete", "sliding")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM y GROUP BY user_id, s""")
def stream_session(spark, d):
    return S.drained(S.sessions(S.source(spark, d, "events", S.EVENTS), "2 hours"), "complete", "sessions")


@query("SELECT DISTINCT event_id // 3 AS outbox_id FROM events")
def stream_outbox_dedup(spark, d):
    events = S.source(spark, d, "events", S.EVENTS).withColumn("outbox_id", F.floor(F.col("event_id") / 3))
    return S.drained(S.once(events, ["outbox_id"], "40 days").select("outbox_id"), "append", "outbox")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    rows = S.source(spark, d, "events", S.EVENTS).select("user_id", "ts", "event_id")
    return S.upsert_batches(rows, ["user_id"], "ts", "last-events")


@query("""SELECT CASE WHEN event_type IN ('click', 'error') THEN 'REJECTED' WHEN event_id % 7 >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'signup' THEN 'DELETE' END AS action, count(*) AS n FROM events GROUP BY ALL""")
def stream_routing(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "view", "order_created").when(kind == "purchase", "order_updated").when(kind == "signup", "order_line_deleted").otherwise(kind)
    rows = read(spark, d, "events").select(named.alias("event_type"), (F.col("event_id") % 7).alias("attempts"))
    return S.routed(rows).groupBy("status", S.action(F.col("event_type")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT *, max(ts) OVER () - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, mark, event_type, value FROM e)
SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS value FROM w WHERE start + INTERVAL 6 HOUR <= mark GROUP BY ALL""")
def stream_tumbling_closed(spark, d):
    """Windows as they close: the watermark ends their state, and each is given once."""
    return S.drained(S.tumbling(S.source(spark, d, "events", S.EVENTS), "6 hours"), "append", "tumbling-closed")


@query("""SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT CASE WHEN event_type = 'click' OR event_id % 50 = 0 THEN 'REJECTED' WHEN event_id % 7 >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status, event_id % 7 AS attempts FROM events) GROUP BY 1 UNION ALL SELECT 'RETRIED', count(*), CAST(sum(event_id % 7 + 1) AS BIGINT) FROM events WHERE event_type <> 'click' AND event_id % 50 <> 0 AND event_id % 7 < 5""")
def stream_dead_letters(spark, d):
    named = F.when(F.col("event_type") == "click", "click").otherwise("order_updated")
    payload = F.when(F.col("event_id") % 50 == 0, F.repeat(F.lit("x"), (1 << 20) + 1)).otherwise("x")
    rows = S.routes(read(spark, d, "events").select(named.alias("event_type"), (F.col("event_id") % 7).alias("attempts"), payload.alias("payload")))
    rows["RETRIED"] = S.failed(rows["PENDING"], F.lit("no answer"))
    out = None
    for name, df in rows.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts")).withColumn("status", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
