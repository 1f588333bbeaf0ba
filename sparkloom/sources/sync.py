"""Keeping tables in step: versions with a swap, master data, checked upserts, histories, retention, graphs, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.sources.tables import latest, merge


class Versions:
    """A table as numbered folders under a root in the shared store; each write is a new folder, and a log of small files says which is current.

    A reader sees the last whole version; a run that starts again goes on from it. A number is written once.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _log(self) -> DataFrame:
        return self.spark.read.schema("version long").parquet(f"{self.root}/log")

    def number(self) -> int | None:
        from pyspark.errors import AnalysisException

        try:
            return self._log().agg(F.max("version")).first()[0]
        except AnalysisException:  # nothing written yet
            return None

    def read(self) -> DataFrame:
        n = self.number()
        return self.spark.createDataFrame([], self.schema) if n is None else self.spark.read.schema(self.schema).parquet(f"{self.root}/v{n}")

    def write(self, df: DataFrame, number: int | None = None) -> int:
        """The next version (or a given later number, as that of a stream's batch; one that is there already changes nothing)."""
        now = self.number()
        n = number if number is not None else (0 if now is None else now + 1)
        if now is not None and n <= now:
            return now
        df.write.mode("overwrite").parquet(f"{self.root}/v{n}")
        self.spark.range(n, n + 1, 1, 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{self.root}/log")
        return n


def upsert(table: Versions, rows: DataFrame, key: list[str], order: str | None = None, number: int | None = None, stamp: str | None = None) -> int:
    """A new version with rows merged by key; with order the newest row of a key stays. stamp: a column that gets the time of the load."""
    new = rows.withColumn(stamp, F.current_timestamp()) if stamp else rows
    if order:
        new = latest(new, key, [F.desc(order)])
        both = table.read().unionByName(new)
        return table.write(latest(both, key, [F.desc(order)]), number)
    return table.write(merge(table.read(), new, key), number)


def master_data(rows: DataFrame, kind: str, code: str, descriptions: list[str], order: str) -> DataFrame:
    """(entity_type, code, name, key): distinct codes, each with the first row's descriptions joined by a space; a stable key from type and code."""
    clean = F.trim(F.col(code).cast("string"))
    parts = [F.nullif(F.trim(F.col(d).cast("string")), F.lit("")) for d in descriptions]
    named = rows.select(clean.alias("code"), F.concat_ws(" ", *parts).alias("name"), F.col(order).alias("__order")).filter("code <> ''")
    first = named.groupBy("code").agg(F.min_by("name", "__order").alias("name"))
    return first.select(F.lit(kind).alias("entity_type"), "code", "name", F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "code"), 256), 1, 16).alias("key"))


def renamed(target: DataFrame, source: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """The target after a sync: new keys are added, of those there only the name changes."""
    new = source.select(F.col(key), F.col(name).alias("__name"))
    kept = target.join(new, key, "left").withColumn(name, F.coalesce("__name", name)).drop("__name")
    return kept.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def checked(target: DataFrame, source: DataFrame, key: list[str], fields: list[str], start: str, end: str) -> DataFrame:
    """(*key, status, reason, changed) of each distinct row of source: failed for a reversed range of dates or a key that the batch gives
    different rows, else inserted, updated with the names of changed fields, or skipped."""
    rows = source.select(*key, *fields).distinct()
    several = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
    t = target.select(*key, *[F.col(f).alias(f"__t_{f}") for f in fields], F.lit(True).alias("__there"))
    out = rows.join(several, key).join(t, key, "left")
    reason = F.when(F.col(start) > F.col(end), "DATE_RANGE").when(F.col("__rows") > 1, "CONFLICT")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__t_{f}")), F.lit(f)) for f in fields]))
    changed = F.when(F.col("__there") & reason.isNull(), F.array_join(changed, ",")).otherwise("")
    status = F.when(reason.isNotNull(), "failed").when(F.col("__there").isNull(), "inserted").when(changed != "", "updated").otherwise("skipped")
    return out.select(*key, status.alias("status"), reason.alias("reason"), changed.alias("changed"))


def history(events: DataFrame, key: str, at: str, action: str, image: list[str]) -> DataFrame:
    """(key, version, action, valid_from, valid_to, *image): each CREATE and UPDATE adds the image after it; a version ends where the next event of any kind comes."""
    w = Window.partitionBy(key).orderBy(at, action)
    rows = events.filter(F.col(action).isin("CREATE", "UPDATE", "DELETE")).withColumn("valid_to", F.lead(at).over(w)).filter(F.col(action) != "DELETE")
    return rows.withColumn("version", F.row_number().over(w)).select(key, "version", F.col(action).alias("action"), F.col(at).alias("valid_from"), "valid_to", *image)


def retained(rows: DataFrame, parents: DataFrame, key: str, closed: Column, old: Column) -> DataFrame:
    """Rows but those that are old and whose parent is closed."""
    gone = parents.filter(closed).select(key).distinct().withColumn("__closed", F.lit(True))
    return rows.join(gone, key, "left").filter(~(F.coalesce(F.col("__closed"), F.lit(False)) & F.coalesce(old, F.lit(False)))).drop("__closed")


def graph_release(nodes: DataFrame, edges: DataFrame, release: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, ...) and edges (a, b, ...) of a release as they are written: one node a key, and only edges of which both ends are there."""
    n = nodes.dropDuplicates(["node"]).withColumn("release_id", F.lit(release))
    ends = n.select("node")
    e = edges.join(ends.withColumnRenamed("node", "a"), "a", "left_semi").join(ends.withColumnRenamed("node", "b"), "b", "left_semi")
    return n, e.dropDuplicates(["a", "b"]).withColumn("release_id", F.lit(release))


def vector_rows(chunks: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Chunk records fit for a vector table: the first of a key, vectors of the given size without nulls."""
    good = (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return chunks.filter(good).dropDuplicates([key])


def sheet_markdown(rows: DataFrame, sheet: str, order: str, columns: list[str], most_rows: int = 2000, most_chars: int = 200) -> DataFrame:
    """(sheet, line_no, line): each sheet as a markdown table, the head as lines 0 and 1, at most most_rows rows; cells are cut, and bars and line feeds in them replaced."""
    cell = lambda c: F.regexp_replace(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, most_chars), r"[|\r\n]", " ")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    n = F.row_number().over(Window.partitionBy(sheet).orderBy(order))
    body = rows.select(sheet, (n + 1).alias("line_no"), line([cell(c) for c in columns]).alias("line")).filter(F.col("line_no") < most_rows + 2)
    head = [F.struct(F.lit(0).alias("line_no"), line([F.lit(c) for c in columns]).alias("line")), F.struct(F.lit(1).alias("line_no"), line([F.lit("---") for _ in columns]).alias("line"))]
    top = rows.select(sheet).distinct().select(sheet, F.explode(F.array(*head)).alias("h")).select(sheet, "h.line_no", "h.line")
    return top.unionByName(body)
