"""Chained steps: each step's frame is a view that the next ones read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_STEPS = 5


def run_steps(spark: SparkSession, tables: dict[str, DataFrame], steps: list[tuple[str, str]]) -> DataFrame:
    """steps: (name, SQL); {name} in SQL stands for a table or an earlier step. Lazy: Catalyst sees one plan."""
    if not 1 <= len(steps) <= MOST_STEPS:
        raise ValueError(f"from 1 to {MOST_STEPS} steps")
    frames = dict(tables)
    for name, sql in steps:
        if name in frames:
            raise ValueError(f"{name} is taken")
        frames[name] = spark.sql(sql, **{k: v for k, v in frames.items() if "{" + k + "}" in sql})
    return frames[steps[-1][0]]


def as_view(df: DataFrame) -> str:
    name = f"step_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def carried(df: DataFrame, most_rows: int = 50, list_chars: int = 2000, json_chars: int = 600) -> str:
    """What the next step is told of a step's result: rows with any text are entities, listed; figures alone go as JSON. Both are cut."""
    rows = df.limit(most_rows).collect()
    if any(isinstance(v, str) for r in rows for v in r):
        return "\n".join(", ".join("" if v is None else str(v) for v in r) for r in rows)[:list_chars]
    return json.dumps([r.asDict() for r in rows], default=str, ensure_ascii=False)[:json_chars]


def narrowed(df: DataFrame, column: str, step: DataFrame, by: str) -> DataFrame:
    """The rows of df that an earlier step found: a semi-join, so that no list of values passes through the driver."""
    return df.join(step.select(step[by].alias("__found")), df[column] == F.col("__found"), "left_semi")
