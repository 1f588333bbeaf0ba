"""Text as columns: paragraphs, chunks, normal forms, matching, numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.sources.shared import catalogue_side


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no from 0, paragraph, section): blocks between blank lines; a markdown heading opens a section."""
    rows = df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("paragraph_no", "paragraph"))
    rows = rows.withColumn("paragraph", F.trim("paragraph")).filter("paragraph <> ''")
    heading = F.when(F.col("paragraph").rlike(r"^#{1,6} "), F.regexp_extract("paragraph", r"^#{1,6} +([^\n]*)", 1))
    w = Window.partitionBy(key).orderBy("paragraph_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def slices(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_no, start, chunk): a long block cut at fixed steps; the last one may lie inside the one before. An empty one has no chunk."""
    rows = df.filter(F.char_length(text) > 0).select(key, text, F.posexplode(F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(size - overlap))).alias("chunk_no", "start"))
    return rows.select(key, "chunk_no", "start", F.substr(text, F.col("start") + 1, F.lit(size)).alias("chunk"))


def packed_chunks(df: DataFrame, key: str, text: str, size: int = 500) -> DataFrame:
    """(key, chunk_no, chunk): lines packed in order as long as they fit; a longer line is a chunk of its own. A fold in the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, line: Column) -> Column:
        fits = F.char_length(s["open"]) + F.char_length(line) + 1 <= size
        joined = F.when(s["open"] == "", line).otherwise(F.concat_ws("\n", s["open"], line))
        flushed = F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.when(fits | (s["open"] == ""), F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(flushed.alias("done"), line.alias("open")))

    folded = F.aggregate(F.split(text, "\n"), start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return df.select(key, F.posexplode(folded).alias("chunk_no", "chunk"))


def title_key(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def nfkc(column: Column) -> Column:
    """Compatibility forms folded; the built-in functions have none."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return fold(column)


def identifier_words(name: Column) -> Column:
    """Words of camelCase and snake_case names."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_\\s-]+"), lambda w: w != "")


def fragments(text: Column, low: int = 2, high: int = 6) -> Column:
    """Distinct pieces of low to high characters."""
    n = F.char_length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(low, high + 1)])))


def longest_term(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term): the longest of terms (term), of 2 to 6 characters, inside a text, the first of equally long ones. Texts are never broadcast."""
    found = df.select(key, F.explode(fragments(text)).alias("term")).join(catalogue_side(terms.select("term"), "terms"), "term")
    return found.groupBy(key).agg(F.min_by("term", F.struct(-F.char_length("term"), "term")).alias("term"))


def token_estimate(text: Column) -> Column:
    """Ideographs, and a quarter of the other characters."""
    ideographs = F.char_length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return ideographs + F.floor((F.char_length(text) - ideographs) / 4).cast("int")


def structure(text: Column) -> Column:
    """RULE, PROCESS, METRIC or CONCEPT, the first that fits; null if none does."""
    return (
        F.when(text.rlike(r"(?i)(at least|at most|more than|less than|>=|<=|>|<|大于|小于|不低于|超过)\s*[0-9]"), "RULE")
        .when(F.regexp_count(text, F.lit(r"(?im)^\s*(step [0-9]+|[0-9]+[.)])\s")) >= 3, "PROCESS")
        .when(text.rlike(r"(?i)=.*(ratio|rate|share|%|率)"), "METRIC")
        .when(text.rlike(r"(?i)(is defined as|refers to|means|是指)"), "CONCEPT")
    )


def scaled_amounts(text: Column) -> Column:
    """Numbers of a text as doubles: thousands commas go, 万 and 亿 scale, % divides."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?\s*(?:万|亿|%)?)"), F.lit(1))

    def number(x: Column) -> Column:
        scale = F.when(F.contains(x, F.lit("万")), 1e4).when(F.contains(x, F.lit("亿")), 1e8).when(F.contains(x, F.lit("%")), 0.01).otherwise(1.0)
        return F.regexp_replace(x, r"[^0-9.]", "").try_cast("double") * scale

    return F.transform(found, number)
