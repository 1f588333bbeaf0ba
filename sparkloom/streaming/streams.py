"""Event streams: reading logs, windows, de-duplication, dead letters, and results as tables.

Results go to tables in the shared folder through foreachBatch, so nothing is gathered on the driver, and a batch that
runs again writes the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.sources import shared

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
MOST_ATTEMPTS = 5


def source(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """The result after all that is there now: append mode gathers batches, complete mode keeps the last."""
    spark = stream.sparkSession
    out, schema = shared.path(spark, name), stream.schema
    spark_path = f"{out}/rows"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(spark_path if mode == "complete" else f"{spark_path}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    try:
        rows = spark.read.schema(schema).parquet(spark_path)
    except AnalysisException:  # no batch has come
        return spark.createDataFrame([], schema)
    return rows.select(*schema.names)


def tumbling(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    return _windowed(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str, step: str, late: str = "1 day") -> DataFrame:
    return _windowed(events, F.window("ts", size, step), late)


def _windowed(events: DataFrame, window: Column, late: str) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("w.start").alias("start"), "last", "n")


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Delivered at least once, passed on once, while a key's copies come within the bound."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def routed(events: DataFrame) -> DataFrame:
    """A status for outbox rows: the type must be entity_created, _updated or _deleted, and attempts are bounded."""
    ok = F.col("event_type").rlike("^[a-z_]+_(created|updated|deleted)$")
    status = F.when(~F.coalesce(ok, F.lit(False)), "REJECTED").when(F.col("attempts") >= MOST_ATTEMPTS, "DEAD").otherwise("PENDING")
    return events.withColumn("status", status)


def action(event_type: Column) -> Column:
    """CREATE, UPDATE or DELETE from an outbox type."""
    verb = F.substring_index(event_type, "_", -1)
    return F.when(verb == "created", "CREATE").when(verb == "updated", "UPDATE").when(verb == "deleted", "DELETE")


def due(schedules: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """Active schedules whose time has come, the oldest first."""
    return schedules.filter(F.col("active") & (F.col("next_run") <= now)).orderBy("next_run", "schedule_id").limit(most)


def upsert_batches(stream: DataFrame, key: list[str], order: str, name: str, root: str | None = None) -> DataFrame:
    """The newest row of each key: each batch is merged into a new version of the table.

    Versions and the stream's position are under root in the shared folder, so that a run with the same root goes on where
    one ended, and a batch that comes again changes nothing.
    """
    from sparkloom.sources.sync import Versions, upsert

    spark, schema = stream.sparkSession, stream.schema
    out = root or shared.path(spark, name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def write(batch: DataFrame, epoch: int) -> None:
        upsert(Versions(batch.sparkSession, f"{out}/table", fields), batch, key, order, epoch)

    stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return Versions(spark, f"{out}/table", fields).read()


def routes(events: DataFrame, payload: str = "payload", most_bytes: int = 1 << 20) -> dict[str, DataFrame]:
    """Rows of routed by what becomes of them: those to be delivered, those given up, those refused; a payload of more than most_bytes is refused."""
    rows = routed(events)
    large = F.coalesce(F.octet_length(payload) > most_bytes, F.lit(False)) if payload in events.columns else F.lit(False)
    rows = rows.withColumn("status", F.when(large, "REJECTED").otherwise(F.col("status")))
    return {s: rows.filter(F.col("status") == s) for s in ("PENDING", "DEAD", "REJECTED")}


def failed(rows: DataFrame, error: Column, most_chars: int = 500) -> DataFrame:
    """Rows after a delivery that failed: one attempt more and the error, cut."""
    return rows.withColumn("attempts", F.col("attempts") + 1).withColumn("last_error", F.substring(error, 1, most_chars))
