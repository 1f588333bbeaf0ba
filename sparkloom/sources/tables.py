"""Reading and writing tables: parquet, row-count reconciliation, upserts without a table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational source, read in ranges of a numeric key at once."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options
    ).load()


def load_snapshot(df: DataFrame, path: str) -> None:
    """A whole table with the time of loading."""
    df.withColumn("etl_load_ts", F.current_timestamp()).write.mode("overwrite").parquet(path)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(by)).filter("__rn = 1").drop("__rn")


def merge(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The target after an upsert: source rows replace those of the same key, others are added, none is deleted.

    Write the result to a new path and swap: a path can't be read and overwritten at once.
    """
    return target.join(source.select(*key), key, "left_anti").unionByName(source)


def insert_absent(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The rows of source whose key the target lacks."""
    return source.join(target.select(*key), key, "left_anti")


def since(df: DataFrame, column: str, watermark: str) -> DataFrame:
    """Rows from the watermark on; the boundary is read again, which a merge by key makes harmless."""
    return df.filter(F.col(column) >= F.lit(watermark).cast("timestamp"))


def next_watermark(sources: list[DataFrame], column: str, epoch: str = "1900-01-01") -> DataFrame:
    """One row: the greatest value of column over sources, the epoch for empty ones."""
    parts = [s.agg(F.coalesce(F.max(column), F.lit(epoch).cast("timestamp")).alias("w")) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.max("w").alias("watermark"))


def outcomes(target: DataFrame, source: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Each source row as inserted, updated (with the names of changed fields) or skipped (identical)."""
    t = target.select(*key, *[F.col(f).alias(f"__t_{f}") for f in fields], F.lit(True).alias("__there"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__t_{f}")), F.lit(f)) for f in fields]))
    out = source.join(t, key, "left").withColumn("changed", F.when(F.col("__there"), changed).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("__there").isNull(), "inserted").when(F.size("changed") > 0, "updated").otherwise("skipped")
    return out.select(*key, status.alias("status"), F.array_join("changed", ",").alias("changed"))


def counts_agree(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """(table, source_rows, target_rows, agree) for every table of either side."""
    def counted(side: dict[str, DataFrame], name: str) -> DataFrame:
        out = None
        for table, df in side.items():
            row = df.agg(F.count(F.lit(1)).alias(name)).withColumn("table", F.lit(table))
            out = row if out is None else out.unionByName(row)
        return out

    both = counted(source, "source_rows").join(counted(target, "target_rows"), "table", "full_outer")
    return both.withColumn("agree", F.col("source_rows").eqNullSafe(F.col("target_rows")))


def value_domains(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column, value): up to most distinct values of each of up to six columns, the smallest ones."""
    out = None
    for c in columns[:6]:
        part = df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").limit(most)
        out = part if out is None else out.unionByName(part)
    return out
