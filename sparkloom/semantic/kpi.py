"""Guards before a metric is computed, the tier that answers for a KPI, its execution, and the layers of its definition."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.semantic.model import Catalog, CompileError, Measure, Metric, compute

# fixed values: the roles of a metric's sources and the sources that can be executed
BASE, NUMERATOR, DENOMINATOR, FILTER = "BASE", "NUMERATOR", "DENOMINATOR", "FILTER"
EXECUTABLE = ("COMPILED", "ESCAPE_HATCH")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Source:
    table: str
    role: str


def measure_table(m: Measure, sources: list[Source], role: str) -> str:
    """The table of a measure: its own; else the only one of its role, for a numerator also the only base. None or several is an error."""
    if m.table:
        return m.table
    for wanted in (NUMERATOR, BASE) if role == NUMERATOR else (DENOMINATOR,):
        tables = {s.table for s in sources if s.role.strip().upper() == wanted}
        if len(tables) == 1:
            return tables.pop()
        if tables:
            break
    raise CompileError("MEASURE_CLASS_UNRESOLVED", role.lower())


def guarded(metric: Metric, sources: list[Source], grain_keys: tuple[str, ...] = ()) -> tuple[Metric, list[str]]:
    """The metric with the tables of its measures, and warnings. What would inflate or mix sums is refused.

    A source that only filters and is no measure's table would multiply rows; an expression of several columns is
    ambiguous where the metric spans two tables. Keys of a grain that is not asked for are ignored with a warning.
    """
    top = replace(metric.numerator, table=measure_table(metric.numerator, sources, NUMERATOR))
    bottom = metric.denominator and replace(metric.denominator, table=measure_table(metric.denominator, sources, DENOMINATOR))
    tables = {top.table, *([bottom.table] if bottom else [])}
    extra = {s.table for s in sources if s.role.strip().upper() == FILTER} - tables
    if extra:
        raise CompileError("FILTER_SOURCE_UNSUPPORTED", ", ".join(sorted(extra)))
    for m in (top, bottom):
        if len(tables) > 1 and m and m.expr and not IDENTIFIER.fullmatch(m.expr.strip()):
            raise CompileError("EXPR_CROSS_TABLE_UNSUPPORTED", m.expr)
    warnings = ["GRAIN_KEYS_IGNORED"] if set(grain_keys) - set(metric.grain) else []
    return replace(metric, numerator=top, denominator=bottom, base=metric.base or top.table), warnings


def side(catalog: Catalog, m: Measure, grain: tuple[str, ...]) -> DataFrame:
    """A measure of one table by its grain, under the name value."""
    one = Metric("value", "MEASURE", m, base=m.table, grain=grain)
    return compute(catalog, one)


def by_sides(catalog: Catalog, metric: Metric) -> DataFrame:
    """A weighted ratio or difference of two tables, each aggregated on its own before they meet: rows of one don't multiply the other's."""
    top, bottom = (side(catalog, m, metric.grain).withColumnRenamed("value", n) for m, n in ((metric.numerator, "__top"), (metric.denominator, "__bottom")))
    both = top.join(bottom, list(metric.grain), "full_outer") if metric.grain else top.join(F.broadcast(bottom))
    value = F.col("__top") - F.col("__bottom") if metric.kind == "DIFFERENCE" else F.col("__top") / F.nullif(F.col("__bottom"), F.lit(0))
    return both.select(*metric.grain, value.alias(metric.name))


def tier(kpis: DataFrame) -> DataFrame:
    """kpis with (tier, reason): the first of the conditions that fails decides.

    Columns: switch_on, kpi_found, metric_present, execution_source, has_datasource, explicit_time, time_ready,
    formula_present, eligible. Null counts as false or missing.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    source = F.upper(F.trim(F.coalesce("execution_source", F.lit(""))))
    ladder = [
        (~yes("switch_on"), "LEGACY", "TIER_A_DISABLED"),
        (~yes("kpi_found"), "LEGACY", "KPI_NOT_FOUND"),
        (~yes("metric_present"), "C", "METRIC_MISSING"),
        (source == "", "C", "EXECUTION_SOURCE_MISSING"),
        (source == "NONE", "C", "EXECUTION_SOURCE_NONE"),
        (~source.isin(*EXECUTABLE), "C", "EXECUTION_SOURCE_UNKNOWN"),
        (~yes("has_datasource"), "C", "DATASOURCE_MISSING"),
        (yes("explicit_time") & ~yes("time_ready"), "B", "EXPLICIT_TIME_SCOPE"),
        (~yes("formula_present"), "B", "FORMULA_EMPTY"),
        (~yes("eligible"), "B", "RECONCILE_NOT_ELIGIBLE"),
    ]
    where = F.lit(None).cast("string")
    why = F.lit(None).cast("string")
    for condition, t, reason in reversed(ladder):
        where, why = F.when(condition, t).otherwise(where), F.when(condition, reason).otherwise(why)
    return kpis.withColumn("tier", F.coalesce(where, F.lit("A"))).withColumn("reason", why)


def execute(df: DataFrame, row_limit: int = 100) -> DataFrame:
    """One row (ok, value, row_count, truncated, reason): at most row_limit rows are fetched, and one more to know whether there are more.

    value is the first value of the first row that is not null, as text.
    """
    spark: SparkSession = df.sparkSession
    schema = "ok boolean, value string, row_count long, truncated boolean, reason string"
    try:
        rows = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).take(row_limit + 1)
    except Exception as e:  # a metric that fails is an answer, not the end of a run
        return spark.createDataFrame([(False, None, 0, False, f"EXECUTION_ERROR: {type(e).__name__}")], schema)
    shown = rows[:row_limit]
    value = next((v for v in (shown[0] if shown else []) if v is not None), None)
    if value is None:
        return spark.createDataFrame([(False, None, len(shown), False, "EMPTY_RESULT")], schema)
    return spark.createDataFrame([(True, value, len(shown), len(rows) > row_limit, None)], schema)


def reconcile(governed: DataFrame, technical: DataFrame, executable: DataFrame, code: str = "code") -> DataFrame:
    """(code, in_governed, in_technical, in_executable, status) of each metric code of any layer: ALIGNED where all three have it."""
    marked = [df.select(code).distinct().withColumn(n, F.lit(True)) for df, n in ((governed, "in_governed"), (technical, "in_technical"), (executable, "in_executable"))]
    both = marked[0].join(marked[1], code, "full_outer").join(marked[2], code, "full_outer").fillna(False)
    status = (
        F.when(F.col("in_governed") & F.col("in_technical") & F.col("in_executable"), "ALIGNED")
        .when(F.col("in_governed") & ~F.col("in_technical"), "NOT_MODELLED")
        .when(~F.col("in_governed"), "NOT_GOVERNED")
        .otherwise("NOT_EXECUTABLE")
    )
    return both.withColumn("status", status)


def domain_slice(classes: DataFrame, joins: DataFrame, seeds: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The classes (name, parent) of a domain: the seeds (name) and all their parents; and the joins (source, target) with both ends inside."""
    from sparkloom.sources.shared import saved

    seen = frontier = saved(classes.join(seeds, "name", "left_semi").select("name", "parent"), "slice")
    for _ in range(most):
        up = frontier.select(F.col("parent").alias("name")).filter("name is not null").distinct().join(seen.select("name"), "name", "left_anti")
        frontier = saved(classes.join(up, "name", "left_semi").select("name", "parent"), "slice")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    names = seen.select("name").distinct()
    inside = joins.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    return names, inside.select("source", "target")


def slice_metrics(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """The metrics (metric, class), each once, that touch a class of a slice."""
    return metrics.join(names.withColumnRenamed("name", "class"), "class", "left_semi").select("metric").distinct()


def duplicates(manifest: DataFrame) -> DataFrame:
    """(section, name, n) of a manifest's entries (section, name) that a release may not have: names that repeat without regard to case."""
    rows = manifest.groupBy("section", F.lower(F.trim("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1")


def landing_gaps(bindings: DataFrame, physical: DataFrame) -> DataFrame:
    """(table, column, problem) of bindings whose table or column is not among the physical ones (table, column), without regard to case."""
    key = lambda c: F.upper(F.trim(c))
    p = physical.select(key("table").alias("t"), key("column").alias("c")).distinct()
    tables = p.select("t").distinct().withColumn("has_table", F.lit(True))
    out = bindings.select("table", "column", key("table").alias("t"), key("column").alias("c")).join(p, ["t", "c"], "left_anti").join(tables, "t", "left")
    return out.select("table", "column", F.when(F.col("has_table"), "COLUMN_MISSING").otherwise("TABLE_MISSING").alias("problem"))


def logical_type(physical: Column) -> Column:
    """A logical type for a database's column type, without regard to case; STRING where it is not known."""
    t = F.upper(F.trim(physical))
    return (
        F.when(t.rlike(r"^TINYINT\(1\)$|^BOOL"), "BOOLEAN")
        .when(t.rlike(r"^(TINYINT|SMALLINT|MEDIUMINT|INT|INTEGER|BIGINT|SERIAL)\b") | t.rlike(r"^NUMBER\(\d+(,\s*0)?\)$"), "INT")
        .when(t.rlike(r"^(DECIMAL|NUMERIC|NUMBER|FLOAT|DOUBLE|REAL|MONEY)\b"), "DECIMAL")
        .when(t.rlike(r"^(DATE|DATETIME|TIMESTAMP|TIME)\b"), "DATETIME")
        .otherwise("STRING")
    )


def imported(tables: DataFrame, blacklist: list[str] = ()) -> DataFrame:
    """The tables (table) that an import takes: not temporary ones (tmp_, temp_, #), not those of the blacklist, without regard to case."""
    name = F.lower(F.trim("table"))
    return tables.filter(~name.rlike("^(tmp_|temp_|#)") & ~name.isin([b.strip().lower() for b in blacklist]))


def columns_of(formula: str, known: list[str]) -> list[str]:
    """The known columns that a formula names, in order: string literals and what follows an alias and a dot are read as such."""
    bare = re.sub(r"'(?:[^']|'')*'", " ", formula)
    names = [m.group(0) for m in IDENTIFIER.finditer(bare) if not bare[m.end() :].lstrip().startswith(("(", "."))]
    by_lower = {k.lower(): k for k in known}
    return list(dict.fromkeys(by_lower[n.lower()] for n in names if n.lower() in by_lower))


def denominator_gaps(formula: str, declared: list[str], known: list[str]) -> list[str]:
    """The declared denominator columns that are not right of a formula's first division."""
    bare = re.sub(r"'(?:[^']|'')*'", " ", formula)
    right = columns_of(bare.partition("/")[2], known)
    return [c for c in declared if c not in right]
