"""Matching names, phrases and keyword sets against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.sources.shared import catalogue_side


KEY = 3


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of up to size characters of a text, one from each place."""
    n = F.char_length(text)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def longest_phrase(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, phrase, code, ambiguous): the longest of phrases (phrase, code) inside a text; ambiguous if equally long ones have other codes.

    Texts and phrases meet on a phrase's first characters, KEY of them or all of a shorter one; what meets is compared.
    Texts are never broadcast.
    """
    low = texts.select(key, F.lower(text).alias("__text"))
    sizes = [r[0] for r in phrases.select(F.least(F.char_length("phrase"), F.lit(KEY)).alias("n")).filter("n > 0").distinct().collect()]  # 1 to KEY
    runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("__text"), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    keyed = phrases.select("phrase", "code", F.substr("phrase", F.lit(1), F.lit(KEY)).alias("__run"))
    keyed = catalogue_side(keyed, "phrases")
    hits = low.select(key, "__text", F.explode(runs).alias("__run")).join(keyed, "__run").filter(F.contains("__text", F.col("phrase"))).select(key, "phrase", "code").distinct()
    best = hits.withColumn("__n", F.max(F.char_length("phrase")).over(Window.partitionBy(key))).filter(F.char_length("phrase") == F.col("__n"))
    return best.groupBy(key).agg(F.min("phrase").alias("phrase"), F.min_by("code", "phrase").alias("code"), (F.count_distinct("code") > 1).alias("ambiguous"))


def keyword_match(texts: DataFrame, key: str, words: Column, catalogue: DataFrame) -> DataFrame:
    """(key, code, confidence): keyword sets (code, keywords, threshold) that are near enough, by Jaccard similarity.

    Sets meet on words that both have; a threshold of 0 or less, which sets without a common word reach, is refused.
    """
    if not catalogue.filter("threshold <= 0").isEmpty():
        raise ValueError("thresholds must be positive")
    w = texts.select(key, F.array_distinct(words).alias("__w"))
    c = catalogue.select("code", F.array_distinct("keywords").alias("__k"), "threshold")
    keyed = catalogue_side(c.select("code", "threshold", F.size("__k").alias("__nk"), F.explode("__k").alias("__x")), "keywords")
    sides = w.select(key, F.size("__w").alias("__nw"), F.explode("__w").alias("__x")).join(keyed, "__x")
    rows = sides.groupBy(key, "code", "threshold", "__nw", "__nk").agg(F.count(F.lit(1)).alias("__both"))
    rows = rows.withColumn("confidence", F.col("__both") / (F.col("__nw") + F.col("__nk") - F.col("__both"))).filter(F.col("confidence") >= F.col("threshold"))
    return rows.select(key, "code", F.round("confidence", 4).alias("confidence"))


def resolve(names: DataFrame, entities: DataFrame, code: str, name: str) -> DataFrame:
    """(input, how, code, candidates): a number is a code; else the exact name; else the only name that contains the input; else AMBIGUOUS or UNKNOWN."""
    e = entities.select(F.col(code).alias("code"), F.col(name).alias("name"))
    by_code = names.join(e, names["input"].try_cast("bigint") == e["code"]).select("input", F.lit(1).alias("rank"), "code")
    by_name = names.join(e, names["input"] == e["name"]).select("input", F.lit(2).alias("rank"), "code")
    # an input meets the names that have its first characters somewhere, and only those are searched for it
    sizes = [r[0] for r in names.select(F.least(F.char_length("input"), F.lit(KEY)).alias("n")).filter("n > 0").distinct().collect()]  # 1 to KEY
    runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("name"), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    keyed = e.select("code", "name", F.explode(runs).alias("__run"))
    asked = catalogue_side(names.select("input", F.substr("input", F.lit(1), F.lit(KEY)).alias("__run")), "inputs")
    inside = keyed.join(asked, "__run").filter(F.contains("name", "input")).select("input", F.lit(3).alias("rank"), "code").distinct()
    found = by_code.unionByName(by_name).unionByName(inside)
    best = found.withColumn("__r", F.min("rank").over(Window.partitionBy("input"))).filter("rank = __r")
    g = best.groupBy("input").agg(F.min("rank").alias("rank"), F.min("code").alias("code"), F.count(F.lit(1)).alias("candidates"))
    how = F.when(F.col("candidates").isNull(), "UNKNOWN").when(F.col("candidates") > 1, "AMBIGUOUS").when(F.col("rank") == 1, "CODE").when(F.col("rank") == 2, "NAME").otherwise("PART")
    out = names.join(g, "input", "left").withColumn("how", how)
    return out.select("input", "how", F.when(F.col("how").isin("CODE", "NAME", "PART"), F.col("code")).alias("code"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def clearance(role: Column) -> Column:
    """The document levels a role may read."""
    levels = lambda *x: F.array(*map(F.lit, x))
    return F.when(role == "compliance", levels("L0", "L1", "L2", "L3")).when(role == "restricted", levels("L0", "L1", "L2")).otherwise(levels("L0", "L1"))


def shared_keys(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, other, key): columns whose name after the prefix is another table's first column. Metadata only."""
    bare = lambda c: c.partition("_")[2]
    firsts = {bare(df.columns[0]): t for t, df in frames.items()}
    return sorted((t, firsts[bare(c)], bare(c)) for t, df in frames.items() for c in df.columns if firsts.get(bare(c), t) != t)
