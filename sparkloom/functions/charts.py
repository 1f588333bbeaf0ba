"""What a result is best shown as, directions in claims, and sentences from figures; all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: thresholds of the chart rules
PIE_ROWS, BAR_ROWS, COVERAGE, STEPS = 6, 15, 0.6, 12
# fixed values: words of a direction, of negation, and the auxiliaries a negation may come through
UP, DOWN = ["涨", "上升", "增长", "增加", "提高"], ["跌", "下降", "减少", "降低", "下滑"]
NOT, AUXILIARIES, GAP = "不未没无非莫", "会应该能肯要再有是", 4

SIGNALS = {
    "row_count": "long", "measures": "int", "dimensions": "int", "has_time": "boolean", "share_formula": "boolean", "is_top_n": "boolean", "ranking": "boolean",
    "waterfall": "boolean", "decomposable": "boolean", "combo": "boolean", "raw_detail": "boolean", "coverage": "double", "question_share": "boolean",
}


def chart(signals: DataFrame) -> DataFrame:
    """signals (columns of SIGNALS) with (kind, rule): the first rule that fits. Null counts as false or 0."""
    c = {n: F.coalesce(F.col(n), F.lit(False) if t == "boolean" else F.lit(0)) for n, t in SIGNALS.items()}
    rows, m, d = c["row_count"], c["measures"], c["dimensions"]
    one = (d == 1) & (m >= 1)
    few = rows <= PIE_ROWS
    ladder = [
        ((rows == 0) | (m + d + c["has_time"].cast("int") == 0), "TABLE", "R00_EMPTY_TABLE"),
        ((rows == 1) & (m == 1) & (d <= 1), "KPI", "R01_SINGLE_VALUE_KPI"),
        ((rows == 1) & (m >= 1) & ((m >= 2) | (d >= 2)), "TABLE", "R01S_SINGLE_ROW_TABLE"),
        (c["share_formula"] & (m == 1) & (d == 1) & few, "DONUT", "R02_SHARE_DONUT"),
        (c["share_formula"] & (m == 1) & (d == 1), "HBAR", "R03_SHARE_OVERFLOW_HBAR"),
        ((c["is_top_n"] | c["ranking"]) & ~c["has_time"] & (d >= 1) & (m >= 1), "HBAR", "R04_TOPN_HBAR"),
        (c["ranking"] & c["has_time"] & (m >= 1), "HBAR", "R04_TOPN_HBAR"),
        (c["waterfall"] & c["decomposable"] & (d == 1) & (m == 1) & rows.between(2, STEPS), "WATERFALL", "R05_WATERFALL"),
        (c["has_time"] & (m >= 2) & (c["combo"] | c["share_formula"]), "COMBO", "R06_COMBO"),
        (c["has_time"] & (m >= 1), "LINE", "R07_TREND_LINE"),
        ((m == 2) & (d <= 1), "SCATTER", "R08_RELATION_SCATTER"),
        (c["raw_detail"] & (d >= 2), "TABLE", "R13_RAW_DETAIL_TABLE"),
        ((d == 2) & (m == 1) & (c["coverage"] >= COVERAGE), "HEATMAP", "R09_MULTIDIM_HEATMAP"),
        ((d == 2) & (m == 1), "BAR", "R10_MULTIDIM_BAR"),
        (one & (rows > BAR_ROWS), "HBAR", "R11_HBAR_MANY_ROWS"),
        (one & c["question_share"] & few, "DONUT", "R12S_QUESTION_SHARE_DONUT"),
        (one & c["question_share"], "HBAR", "R12S_QUESTION_SHARE_HBAR"),
        (one, "BAR", "R12_CATEGORY_BAR"),
    ]
    kind, rule = F.lit("TABLE"), F.lit("R14_DEFAULT_TABLE")
    for condition, k, r in reversed(ladder):
        kind, rule = F.when(condition, k).otherwise(kind), F.when(condition, r).otherwise(rule)
    return signals.withColumn("kind", kind).withColumn("rule", rule)


def spec(kind: str, dimensions: list[str], measures: list[str], sort: str | None = None, labels: dict[str, str] | None = None) -> dict:
    """A chart's description: at most two dimensions and two measures, with their labels, orientation and order."""
    label = lambda c: (labels or {}).get(c, c.replace("_", " "))
    d, m = dimensions[:2], measures[: 1 if kind == "KPI" else 2]
    return {
        "kind": kind,
        "dimensions": [{"field": c, "label": label(c)} for c in d],
        "measures": [{"field": c, "label": label(c)} for c in m],
        "orientation": "horizontal" if kind == "HBAR" else "vertical",
        "sort": sort if sort in (*d, *m) else None,
    }


def kpi_value(df: DataFrame, measure: str) -> DataFrame:
    """(value): the figure of a KPI card, its first row's."""
    return df.select(F.col(measure).alias("value")).limit(1)


def _said(text: Column, words: list[str]) -> Column:
    negated = f"(?<![{NOT}])(?<![{NOT}][{AUXILIARIES}].{{0,{GAP}}})"
    return F.coalesce(text.rlike(f"{negated}(?:{'|'.join(words)})"), F.lit(False))


def direction(text: Column) -> Column:
    """increase or decrease, as a text claims it; null without either, with both, and for words that are denied."""
    up, down = _said(text, UP), _said(text, DOWN)
    return F.when(up & ~down, "increase").when(down & ~up, "decrease")


def claim(name: Column, tops: Column, low: Column, high: Column, measure: str, original: Column, most: int = 200) -> Column:
    """A sentence from the shares of a dimension's first values (array<struct<value, share>>) and a measure's range; the original claim without values."""
    shares = F.array_join(F.transform(tops, lambda t: F.concat(t["value"], F.lit(" "), F.format_string("%.1f", t["share"]), F.lit("%"))), ", ")
    ranged = F.concat(F.lit(f"; {measure} from "), F.format_string("%.2f", low), F.lit(" to "), F.format_string("%.2f", high))
    text = F.concat(F.lit("by "), name, F.lit(": "), shares, F.when(low.isNotNull() & high.isNotNull(), ranged).otherwise(""))
    return F.when(F.coalesce(F.size(tops), F.lit(0)) > 0, F.substring(text, 1, most)).otherwise(original)
