"""A structured query plan and its DataFrame.

The plan is data (from JSON); unknown or broken parts are dropped and counted. Catalyst does the planning: here a plan
only names tables, columns, aggregates and order, and the joins between its tables come from the catalogue.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.semantic.model import Catalog, CompileError

MOST_ROWS = 1000
# fixed values: a target that says there is no answer; words of time buckets
UNANSWERABLE = ("UNANSWERABLE", "无法回答")
BUCKETS = {"day": "day", "日": "day", "week": "week", "周": "week", "month": "month", "月": "month", "quarter": "quarter", "季度": "quarter", "year": "year", "年": "year"}
AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max,
    "stddev": F.stddev_samp, "variance": F.var_samp, "median": F.median,
}


@dataclass(frozen=True)
class Aggregation:
    alias: str
    function: str | None = None
    column: str | None = None
    formula: str | None = None  # an aggregate expression; goes before function and column


@dataclass(frozen=True)
class Plan:
    table: str
    columns: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    also: tuple[str, ...] = ()  # further tables, joined by catalogue paths
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    having: tuple[str, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()  # (column or alias, asc or desc)
    row_limit: int | None = None
    partition_by: tuple[str, ...] = ()
    per_group_limit: int | None = None
    shares: tuple[tuple[str, str], ...] = ()  # (alias of the share, alias of the amount)
    derived: dict[str, str] = field(default_factory=dict)  # column -> expression, before grouping
    windows: dict[str, str] = field(default_factory=dict)  # column -> window expression, after grouping: ranks, frames
    nulls: str = "large"  # whether nulls sort as the largest or the smallest value


def limit_of(x: Any) -> int | None:
    """A positive whole number, or a string of digits that is one; booleans are none."""
    if isinstance(x, bool):
        return None
    if isinstance(x, str) and x.strip().isdigit():
        x = int(x)
    return x if isinstance(x, int) and x > 0 else None


def from_dict(raw: dict[str, Any]) -> tuple[Plan | None, Counter]:
    """The plan, or None if it names no table, and the parts dropped by (field, reason)."""
    drops: Counter = Counter()

    def texts(key: str) -> tuple[str, ...]:
        found = raw.get(key) or []
        if not isinstance(found, list):
            drops[key, "not a list"] += 1
            return ()
        drops.update((key, "not a text") for x in found if not isinstance(x, str) or not x.strip())
        return tuple(x.strip() for x in found if isinstance(x, str) and x.strip())

    if not isinstance(raw.get("table"), str) or not raw["table"].strip():
        return None, Counter({("table", "missing"): 1})
    if raw["table"].strip().upper() in UNANSWERABLE:
        return None, Counter({("table", "unanswerable"): 1})
    aggregations = []
    for x in raw.get("aggregations") or []:
        known = isinstance(x, dict) and x.get("alias") and (x.get("formula") or (x.get("function") in AGGREGATES and (x.get("column") or x["function"] == "count")))
        if known:
            aggregations.append(Aggregation(x["alias"], x.get("function"), x.get("column"), x.get("formula")))
        else:
            drops["aggregations", "incomplete"] += 1
    sort = []
    for x in raw.get("sort") or []:
        if isinstance(x, dict) and isinstance(x.get("column"), str) and x.get("order", "asc") in ("asc", "desc"):
            sort.append((x["column"], x.get("order", "asc")))
        else:
            drops["sort", "incomplete"] += 1
    row_limit, per_group = limit_of(raw.get("rowLimit")), limit_of(raw.get("perGroupLimit"))
    if row_limit and per_group:
        drops["rowLimit", "excluded by perGroupLimit"] += 1
        row_limit = None
    return Plan(
        raw["table"].strip(), texts("columns"), texts("conditions"), texts("also"), texts("groupBy"), tuple(aggregations), texts("having"),
        tuple(sort), row_limit, texts("partitionBy"), per_group, tuple(map(tuple, raw.get("shares") or ())), dict(raw.get("derived") or {}),
        dict(raw.get("windows") or {}), raw.get("nulls") if raw.get("nulls") in ("large", "small") else "large",
    ), drops


def scope_limit(plan: Plan, asked: bool, scoped: bool, default: int | None = MOST_ROWS) -> Plan:
    """The row limit that fits a question: one asked for stays; a time scope or conditions lift it; aggregates keep what is set."""
    if asked or plan.per_group_limit:
        return plan
    if scoped or plan.conditions:
        return replace(plan, row_limit=None)
    return plan if plan.aggregations else replace(plan, row_limit=plan.row_limit or default)


def ordered(name: str, order: str, nulls: str = "large") -> Column:
    """Nulls sort as the largest value (nulls="large") or the smallest."""
    c = F.col(name)
    if nulls == "large":
        return c.asc_nulls_last() if order == "asc" else c.desc_nulls_first()
    return c.asc_nulls_first() if order == "asc" else c.desc_nulls_last()


def refine(plan: Plan, column: str, comparison: str, value: str) -> Plan:
    """One more condition. comparison: = <> > >= < <=."""
    if comparison not in ("=", "<>", ">", ">=", "<", "<="):
        raise CompileError("BAD_COMPARISON", comparison)
    return replace(plan, conditions=(*plan.conditions, f"{column} {comparison} {value}"))


def between(plan: Plan, column: str, low: str, high: str) -> Plan:
    """One more condition, closed at both ends; a date that is none or a reversed range changes nothing."""
    try:
        first, last = date.fromisoformat(low), date.fromisoformat(high)
    except ValueError:
        return plan
    return replace(plan, conditions=(*plan.conditions, f"{column} between date'{first}' and date'{last}'")) if first <= last else plan


def bucket(column: str, word: str) -> str:
    """The expression of a time bucket from its word."""
    if word.strip().lower() not in BUCKETS:
        raise CompileError("UNKNOWN_BUCKET", word)
    return f"date_trunc('{BUCKETS[word.strip().lower()]}', {column})"


def equality(text: str) -> tuple[str, str] | None:
    """The sides of "A = B" with exactly one sign; None for anything else."""
    left, sign, right = (x.strip() for x in text.partition("="))
    if not sign or not left or not right or "=" in right or left[-1] in "<>!":
        return None
    return left, right


def named(catalog: Catalog, plan: Plan) -> Plan:
    """The plan with logical names and aliases of columns as physical ones; what is none (an alias of the plan, an expression) stays."""
    own = {x.alias for x in plan.aggregations} | {s for s, _ in plan.shares} | set(plan.derived) | set(plan.windows)

    def name(x: str) -> str:
        if x in own:
            return x
        try:
            return catalog.physical(x)
        except CompileError as e:
            if e.reason == "AMBIGUOUS_COLUMN":
                for t in (plan.table, *plan.also):
                    if x in catalog.tables[t].columns:
                        return catalog.tables[t].columns[x]
                raise
            return x

    return replace(
        plan, columns=tuple(map(name, plan.columns)), group_by=tuple(map(name, plan.group_by)), partition_by=tuple(map(name, plan.partition_by)),
        sort=tuple((name(c), o) for c, o in plan.sort), aggregations=tuple(replace(x, column=x.column and name(x.column)) for x in plan.aggregations),
    )


def hints(catalog: Catalog, name: str, most: int = 3) -> list[str]:
    """What a name that no table has may mean: the tables that own it, a time bucket's word, or the nearest names by edit distance."""
    last = name.rpartition(".")[2].lower()
    known = {(c, t.name) for t in catalog.tables.values() for c in (*t.columns, *t.columns.values())}
    owners = sorted({t for c, t in known if c.lower() == last})
    if owners:
        return [f"{t}.{last}" for t in owners]
    if last in BUCKETS:
        return [f"{bucket('a date column', last)}"]
    rows = [(_distance(last, c.lower()), f"{t}.{c}") for c, t in known]
    return [n for d, n in sorted(rows)[:most] if d <= max(2, len(last) // 2)]


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def build(catalog: Catalog, plan: Plan) -> DataFrame:
    """The plan's rows; see named for logical names. Shares are taken of all groups, before any rank or limit cuts rows."""
    df = catalog.joined(plan.table, list(plan.also))
    for c in plan.conditions:
        df = df.filter(F.expr(f"({c})"))
    for name, e in plan.derived.items():
        df = df.withColumn(name, F.expr(e))
    if plan.aggregations:
        aggregates = [
            (F.expr(x.formula) if x.formula else F.count(F.col(x.column) if x.column else F.lit(1)) if x.function == "count" else AGGREGATES[x.function](F.col(x.column))).alias(x.alias)
            for x in plan.aggregations
        ]
        df = df.groupBy(*plan.group_by).agg(*aggregates)
    elif plan.columns:
        df = df.select(*plan.columns)
    for name, e in plan.windows.items():
        df = df.withColumn(name, F.expr(e))
    if plan.shares:  # one row of totals, not a window over all rows in one task
        totals = df.agg(*[F.sum(amount).alias(f"__of_{share}") for share, amount in plan.shares])
        df = df.join(F.broadcast(totals))
        for share, amount in plan.shares:
            df = df.withColumn(share, F.col(amount) / F.nullif(F.col(f"__of_{share}"), F.lit(0)))
        df = df.drop(*[f"__of_{share}" for share, _ in plan.shares])
    for h in plan.having:
        df = df.filter(F.expr(f"({h})"))
    if plan.per_group_limit:
        by = Window.partitionBy(*plan.partition_by).orderBy(*[ordered(*s, plan.nulls) for s in plan.sort])
        return df.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= plan.per_group_limit)
    if plan.sort:
        df = df.orderBy(*[ordered(*s, plan.nulls) for s in plan.sort])
    return df.limit(plan.row_limit) if plan.row_limit else df


def truncated(df: DataFrame, limit: int) -> tuple[list, bool]:
    """At most limit rows, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit
