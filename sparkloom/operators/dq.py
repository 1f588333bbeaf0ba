"""Data quality: rules become columns, and all rules of a table are evaluated in one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Rule:
    code: str
    kind: str  # one of KINDS; TIMELINESS is known, but not evaluated
    table: str
    column: str | None = None
    expression: str | None = None
    threshold: float = 100.0
    reference: tuple[str, str] | None = None  # table, column


def condition(kind: str, column: str, **p) -> str:
    """A rule's expression from parameters. kind: not_null, range, in_set, regex, compare, cross_column."""
    if not NAME.fullmatch(column):
        raise ValueError(f"bad column {column}")
    quoted = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    if kind == "not_null":
        return f"{column} is not null"
    if kind == "range":
        parts = [f"{column} >= {quoted(p['low'])}" if p.get("low") is not None else "", f"{column} <= {quoted(p['high'])}" if p.get("high") is not None else ""]
        return " and ".join(x for x in parts if x)
    if kind == "in_set":
        return f"{column} in ({', '.join(map(quoted, p['values']))})"
    if kind == "regex":
        return f"{column} rlike {quoted(p['pattern'])}"
    if kind in ("compare", "cross_column") and p["operator"] in ("=", "<>", "<", "<=", ">", ">="):
        if kind == "compare":
            return f"{column} {p['operator']} {quoted(p['value'])}"
        if NAME.fullmatch(p["other"]):
            return f"{column} {p['operator']} {p['other']} * {float(p.get('factor', 1))}"
    raise ValueError(f"bad rule {kind}")


def derive(df: DataFrame, table: str, key: str | None = None, allowed: dict[str, list] | None = None, references: dict[str, tuple[str, str]] | None = None) -> list[Rule]:
    """Rules that a schema and its metadata imply."""
    out = []
    if key:
        out.append(Rule(f"{table}.{key}.unique", "UNIQUENESS", table, key))
    for f in df.schema:
        if not f.nullable or f.name == key:
            out.append(Rule(f"{table}.{f.name}.not_null", "COMPLETENESS", table, f.name))
        if isinstance(f.dataType, T.BooleanType):
            out.append(Rule(f"{table}.{f.name}.flag", "VALIDITY", table, f.name, condition("in_set", f.name, values=[True, False])))
    out += [Rule(f"{table}.{c}.allowed", "VALIDITY", table, c, condition("in_set", c, values=v)) for c, v in (allowed or {}).items()]
    out += [Rule(f"{table}.{c}.reference", "REFERENTIAL", table, c, reference=r) for c, r in (references or {}).items()]
    return out


# fixed values: what a text of a declared type looks like, and the texts of flags
TYPE_PATTERNS = {
    "INT": "^-?[0-9]+$",
    "DECIMAL": "^-?[0-9]+([.][0-9]+)?$",
    "DATETIME": "^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$",
}
FLAGS = ["true", "false", "t", "f", "1", "0"]


def derive_types(df: DataFrame, table: str, declared: dict[str, str]) -> list[Rule]:
    """Rules for text columns that are declared to be of another type; a nullable one may be null."""
    out = []
    for f in df.schema:
        kind = declared.get(f.name, "").upper()
        if not isinstance(f.dataType, T.StringType) or kind not in (*TYPE_PATTERNS, "BOOLEAN"):
            continue
        test = condition("in_set", f.name, values=FLAGS) if kind == "BOOLEAN" else condition("regex", f.name, pattern=TYPE_PATTERNS[kind])
        out.append(Rule(f"{table}.{f.name}.type", "VALIDITY", table, f.name, f"{f.name} is null or {test}" if f.nullable else test))
    return out


def date_consistency(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], source_date: str, target_date: str) -> DataFrame:
    """(total, passed): rows of source for which target has a row of the same keys and a date that is not before. Only each key's last date is joined."""
    last = target.groupBy(*[F.col(t).alias(f"__{s}") for s, t in keys]).agg(F.max(target_date).alias("__last"))
    out = source.join(last, [F.col(s) == F.col(f"__{s}") for s, _ in keys], "left")
    return out.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("__last") >= F.col(source_date), F.lit(False))).alias("passed"))


KINDS = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "REFERENTIAL")


def _fault(frames: dict[str, DataFrame], r: Rule) -> str | None:
    """Why a rule can't be evaluated: no such kind, table or column, or an expression that isn't a condition."""
    if r.kind not in KINDS:
        return "KIND"
    if r.table not in frames or (r.kind == "REFERENTIAL" and (r.reference is None or r.reference[0] not in frames)):
        return "TABLE"
    try:
        if r.kind in ("VALIDITY", "CONSISTENCY"):
            field = frames[r.table].select(F.expr(f"({r.expression})").alias("x")).schema[0]
            return None if isinstance(field.dataType, T.BooleanType) else "CONDITION"
        frames[r.table].select(r.column).schema
        if r.kind == "REFERENTIAL":
            frames[r.reference[0]].select(r.reference[1]).schema
    except AnalysisException:
        return "EXPRESSION"
    return None


def evaluate(frames: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(code, kind, table_name, threshold, total, passed, pass_rate, status) of each rule.

    A null never passes; an empty table has rate 0. A rule that doesn't fit its table (or of a kind that is never
    evaluated, as TIMELINESS) has status ERROR and counts of 0 and leaves the others alone. The rules of a table share
    one scan and one aggregate; distinct values are counted apart, so that they don't multiply the rows of the others,
    and a referential rule adds one left join to the distinct values it refers to.
    """
    out = None
    faults = {r.code: _fault(frames, r) for r in rules}
    wrong = [r for r in rules if faults[r.code]]
    for table in dict.fromkeys(r.table for r in rules if not faults[r.code]):
        mine = [r for r in rules if r.table == table and not faults[r.code]]
        df = frames[table]
        aggs, distinct = [F.count(F.lit(1)).alias("total")], []
        for i, r in enumerate(mine):
            if r.kind == "COMPLETENESS":
                passed = F.count(r.column)
            elif r.kind == "UNIQUENESS":
                distinct.append(frames[table].select(r.column).distinct().agg(F.count(r.column).alias(f"p{i}")))
                continue
            elif r.kind == "REFERENTIAL":
                known = frames[r.reference[0]].select(F.col(r.reference[1]).alias(f"__k{i}")).filter(f"__k{i} is not null").distinct()
                df = df.join(known, df[r.column] == known[f"__k{i}"], "left")
                passed = F.count(f"__k{i}")
            else:
                passed = F.count_if(F.expr(f"({r.expression})"))
            aggs.append(passed.alias(f"p{i}"))
        row = df.agg(*aggs)
        for d in distinct:
            row = row.join(F.broadcast(d))  # one row each
        cells = [F.struct(F.lit(r.code).alias("code"), F.lit(r.kind).alias("kind"), F.lit(table).alias("table_name"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"p{i}").alias("passed")) for i, r in enumerate(mine)]
        part = row.select("total", F.explode(F.array(*cells)).alias("r")).select("r.*", "total")
        out = part if out is None else out.unionByName(part)
    if wrong:
        spark = next(iter(frames.values())).sparkSession
        bad = spark.createDataFrame([(r.code, r.kind, r.table, float(r.threshold), 0, 0, "ERROR") for r in wrong], "code string, kind string, table_name string, threshold double, passed long, total long, __error string")
        out = bad if out is None else out.withColumn("__error", F.lit(None).cast("string")).unionByName(bad)
    rate = F.coalesce(F.round(F.col("passed") / F.nullif(F.col("total"), F.lit(0)) * 100, 4), F.lit(0.0))
    out = out.withColumn("pass_rate", rate)
    status = F.when(F.col("pass_rate") >= F.col("threshold"), "PASS").otherwise("FAIL")
    return out.withColumn("status", F.coalesce("__error", status)).drop("__error") if wrong else out.withColumn("status", status)


def violations(frames: dict[str, DataFrame], rule: Rule, key: list[str], most: int | None = 20) -> DataFrame:
    """Keys of rows that break a rule, the first ones by key; all of them without most."""
    df = frames[rule.table]
    if rule.kind == "COMPLETENESS":
        bad = df.filter(F.col(rule.column).isNull())
    elif rule.kind == "UNIQUENESS":
        again = df.groupBy(rule.column).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(rule.column)
        bad = df.join(again, rule.column, "left_semi")
    elif rule.kind == "REFERENTIAL":
        known = frames[rule.reference[0]]
        bad = df.filter(F.col(rule.column).isNotNull()).join(known, df[rule.column] == known[rule.reference[1]], "left_anti")
    else:
        bad = df.filter(~F.coalesce(F.expr(f"({rule.expression})"), F.lit(False)))
    bad = bad.select(*key)
    return bad.orderBy(*key).limit(most) if most else bad


def in_window(df: DataFrame, start: str, end: str, column: str = "created_at") -> DataFrame:
    """Closed at both ends; a table without the column is left as it is."""
    return df.filter(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))) if column in df.columns else df


def scores(results: DataFrame) -> DataFrame:
    """(table_name, kind, score) as unweighted means of pass rates, an OVERALL row of each table, and '*' rows over all rules.

    Rules in ERROR have no rate: a kind of which all rules are in ERROR has a null score and no part in the OVERALL one.
    """
    rate = F.avg(F.when(F.col("status") != "ERROR", F.col("pass_rate"))).alias("score")
    per_kind = results.groupBy("table_name", "kind").agg(rate)
    everywhere = results.groupBy("kind").agg(rate).withColumn("table_name", F.lit("*"))
    both = per_kind.unionByName(everywhere)
    overall = both.groupBy("table_name").agg(F.avg("score").alias("score")).withColumn("kind", F.lit("OVERALL"))
    return both.unionByName(overall).withColumn("score", F.round("score", 2))


def latest_scores(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("table_name", "kind").orderBy(F.desc("evaluated_at"))
    return history.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def undecided(value: Column, operator: str, bound: Column | list) -> Column:
    """A comparison that is null where it can't be decided: numbers compare as numbers, other texts only for equality.

    operator: = != > >= < <= IN NOT IN.
    """
    number = lambda c: F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")
    if operator in ("IN", "NOT IN"):
        found = F.trim(value.cast("string")).isin([str(x).strip() for x in bound])
        return found if operator == "IN" else ~found
    a, b = number(value), number(bound)
    ordered = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}
    if operator in ordered:
        return ordered[operator]
    same = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(F.trim(value.cast("string")) == F.trim(bound.cast("string")))
    return same if operator == "=" else ~same


def rule_kind(operator: Column) -> Column:
    """What a record rule is, by its operator: SET_MEMBERSHIP, THRESHOLD or LOOKUP."""
    op = F.upper(F.trim(operator))
    return F.when(op.isin("IN", "NOT IN"), "SET_MEMBERSHIP").when(op.isin(">=", "<=", ">", "<"), "THRESHOLD").otherwise("LOOKUP")


def matches(*parts: Column) -> tuple[Column, Column]:
    """(matched, decidable): all parts true; no part null."""
    both, known = F.lit(True), F.lit(True)
    for p in parts:
        both, known = both & F.coalesce(p, F.lit(False)), known & p.isNotNull()
    return both, known


def reader(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
