"""Logical tables over physical ones, the catalogue of joins, measures and metrics."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class CompileError(ValueError):
    """A metric or plan that can't be built; reason is a stable code."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


@dataclass(frozen=True)
class Table:
    name: str
    source: str
    columns: dict[str, str] = field(default_factory=dict)  # logical name or alias -> physical column


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    left_columns: tuple[str, ...]
    right_columns: tuple[str, ...]
    kind: str = "inner"


@dataclass(frozen=True)
class Measure:
    agg: str  # sum, avg, count, count_distinct, min, max
    expr: str | None = None
    filter: str | None = None
    table: str | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str  # MEASURE, RATIO, DIFFERENCE
    numerator: Measure
    denominator: Measure | None = None
    order: str = "WEIGHTED_RATIO"  # of RATIO: WEIGHTED_RATIO or AVG_OF_RATIOS
    base: str | None = None
    filters: tuple[str, ...] = ()
    time_column: str | None = None
    grain: tuple[str, ...] = ()


class Catalog:
    """Logical tables and joins; frames are read on demand, so that only needed tables and columns are scanned."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[Table], joins: list[Join]):
        self.spark, self.folder, self.joins = spark, folder, joins
        self.tables = {t.name: t for t in tables}
        for j in joins:
            if len(j.left_columns) != len(j.right_columns) or j.kind not in ("inner", "left"):
                raise CompileError("BAD_JOIN", f"{j.left}-{j.right}")

    def frame(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CompileError("UNKNOWN_CLASS", name)
        return self.spark.read.parquet(f"{self.folder}/{self.tables[name].source}.parquet")

    def physical(self, name: str) -> str:
        """The column of a logical name, an alias, a physical name, or any of these after a table's name."""
        owner, _, last = name.rpartition(".")
        found = {t.columns.get(last) or (last if last in t.columns.values() else None) for t in self.tables.values() if not owner or t.name == owner} - {None}
        if len(found) != 1:
            raise CompileError("AMBIGUOUS_COLUMN" if found else "UNKNOWN_COLUMN", name)
        return found.pop()

    def path(self, start: str, goal: str, most: int = 4) -> list[tuple[Join, bool]]:
        """The shortest chain of joins; True where a join is gone along from left to right."""
        todo, seen = deque([(start, [])]), {start}
        while todo:
            at, chain = todo.popleft()
            if at == goal:
                return chain
            if len(chain) == most:
                continue
            for j in self.joins:
                for here, there, forward in ((j.left, j.right, True), (j.right, j.left, False)):
                    if here == at and there not in seen:
                        seen.add(there)
                        todo.append((there, [*chain, (j, forward)]))
        raise CompileError("NO_JOIN_PATH", f"{start} to {goal}")

    def joined(self, base: str, needed: list[str]) -> DataFrame:
        """The base table with the joins that reach the needed ones, each join once."""
        df, done = self.frame(base), set()
        have = {base}
        for goal in needed:
            for join, forward in self.path(base, goal):
                if id(join) in done:
                    continue
                if join.kind == "left" and not forward:
                    raise CompileError("LEFT_JOIN_REVERSED", f"{join.left} to {join.right}")
                done.add(id(join))
                there = join.right if forward else join.left
                mine, theirs = (join.left_columns, join.right_columns) if forward else (join.right_columns, join.left_columns)
                if there in have:
                    continue
                have.add(there)
                other = self.frame(there)
                df = df.join(other, [df[x] == other[y] for x, y in zip(mine, theirs, strict=True)], join.kind)
        return df


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def measure(m: Measure) -> Column:
    """A measure's filter is inside the aggregate, so it does not take rows from other measures."""
    value = F.expr(m.expr) if m.expr else F.lit(1)
    if m.expr is None and m.agg != "count":
        raise CompileError("MISSING_EXPR", m.agg)
    if m.filter:
        value = F.when(F.expr(f"({m.filter})"), value)
    aggregates = {"sum": F.sum, "avg": F.avg, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max}
    if m.agg not in aggregates:
        raise CompileError("UNSUPPORTED_AGG", m.agg)
    return aggregates[m.agg](value)


def _row_value(m: Measure) -> Column:
    value = F.expr(m.expr) if m.expr else F.lit(1)
    return F.when(F.expr(f"({m.filter})"), value) if m.filter else value


def value(metric: Metric) -> Column:
    if metric.kind == "MEASURE":
        return measure(metric.numerator)
    if metric.kind not in ("RATIO", "DIFFERENCE"):
        raise CompileError("UNSUPPORTED_METRIC", metric.kind)
    if metric.denominator is None:
        raise CompileError("MISSING_DENOMINATOR", metric.name)
    if metric.kind == "DIFFERENCE":
        return measure(metric.numerator) - measure(metric.denominator)
    if metric.order == "WEIGHTED_RATIO":
        return ratio(measure(metric.numerator), measure(metric.denominator))
    if metric.order == "AVG_OF_RATIOS":
        return F.avg(ratio(_row_value(metric.numerator), _row_value(metric.denominator)))
    raise CompileError("UNSUPPORTED_ORDER", metric.order)


def compute(catalog: Catalog, metric: Metric, scope: tuple[str, str] | None = None) -> DataFrame:
    """The metric by its grain: joins to the tables of its measures, filters that each stand in parentheses, a half-open time scope."""
    base = metric.base or metric.numerator.table
    if base is None:
        raise CompileError("NO_BASE_CLASS", metric.name)
    needed = [m.table for m in (metric.numerator, metric.denominator) if m is not None and m.table and m.table != base]
    owners = {c: t.name for t in catalog.tables.values() for c in t.columns.values()}
    needed += [owners[c] for c in (*metric.grain, *([metric.time_column] if metric.time_column else [])) if owners.get(c, base) != base]
    df = catalog.joined(base, list(dict.fromkeys(needed)))
    for f in metric.filters:
        df = df.filter(F.expr(f"({f})"))
    if scope is not None:
        if metric.time_column is None:
            raise CompileError("NO_TIME_COLUMN", metric.name)
        start, end = (F.lit(x).cast("timestamp") for x in scope)
        df = df.filter((F.col(metric.time_column) >= start) & (F.col(metric.time_column) < end))
    return df.groupBy(*metric.grain).agg(value(metric).alias(metric.name))


def star(spark: SparkSession, folder: str) -> Catalog:
    """The purchasing model over the star schema."""
    def table(name: str, source: str, prefix: str, columns: str) -> Table:
        return Table(name, source, {c: prefix + c for c in columns.split()})

    return Catalog(spark, folder, [
        table("line", "lineitem", "l_", "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate"),
        table("order", "orders", "o_", "orderkey custkey orderstatus totalprice orderdate orderpriority"),
        table("customer", "customer", "c_", "custkey name nationkey acctbal mktsegment"),
        table("supplier", "supplier", "s_", "suppkey name nationkey acctbal"),
        table("part", "part", "p_", "partkey name brand type size retailprice"),
        table("nation", "nation", "n_", "nationkey name regionkey"),
        table("region", "region", "r_", "regionkey name"),
    ], [
        Join("line", "order", ("l_orderkey",), ("o_orderkey",)),
        Join("line", "supplier", ("l_suppkey",), ("s_suppkey",), "left"),
        Join("line", "part", ("l_partkey",), ("p_partkey",), "left"),
        Join("order", "customer", ("o_custkey",), ("c_custkey",)),
        Join("customer", "nation", ("c_nationkey",), ("n_nationkey",)),
        Join("nation", "region", ("n_regionkey",), ("r_regionkey",)),
    ])
