"""Time phrases in questions: half-open scopes, the placeholder for one, ranking phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, functions as F

from sparkloom.semantic.model import CompileError
from sparkloom.semantic.timescope import MONTHS, period, recent

# fixed values: years and quarters relative to today, numerals, units
YEARS = {"今年": 0, "本年": 0, "去年": -1, "上年": -1, "明年": 1, "下一年": 1, "前年": -2}
STEPS = {"当前": 0, "本": 0, "这": 0, "上一": -1, "上": -1, "前一": -1, "前": -1, "下一": 1, "下": 1}
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"月": "month", "季度": "quarter", "年": "year"}
SUPERLATIVES = ("最多", "最少", "最高", "最低", "最大", "最小", "highest", "lowest", "most", "least", "largest", "smallest")
MOST_ROWS = 1000

YEAR = r"(?:(?P<year>(?<!\d)(?:19|20)\d{2})\s*年?|(?P<rel>" + "|".join(YEARS) + r")\s*年?)"
QUARTER = r"(?:(?:第\s*)?(?P<cn>[一二三四1-4])\s*季度?|-?\s*[Qq](?P<q>[1-4])(?![0-9A-Za-z]))"


@dataclass(frozen=True)
class Scope:
    start: date
    end: date
    text: str


def number(text: str) -> int | None:
    """An integer in digits or in numerals below 100; None for anything else."""
    if text.isdigit():
        return int(text)
    tens, ten, units = text.partition("十")
    if ten:
        high, low = NUMERALS.get(tens, None if tens else 1), NUMERALS.get(units, None if units else 0)
        return None if high is None or low is None else high * 10 + low
    return NUMERALS.get(text)


def _year(m: re.Match, question: str, today: date) -> int:
    """The year that a match names, else the last one before it, else this one."""
    groups = m.groupdict()
    if groups.get("year"):
        return int(groups["year"])
    if groups.get("rel"):
        return today.year + YEARS[groups["rel"]]
    before = re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", question[: m.start()])
    return int(before[-1]) if before else today.year


def _quarter(m, question, today):
    q = number(m["cn"] or m["q"])
    return period("quarter", date(_year(m, question, today), q * 3, 1))


def _half(m, question, today):
    return period("half_year", date(_year(m, question, today), 1 if m["half"] == "上" else 7, 1))


def _step(grain):
    def scope(m, question, today):
        size = MONTHS[grain]
        at = today.year * 12 + today.month - 1 + STEPS[m["step"]] * size
        return period(grain, date(at // 12, at % 12 + 1, 1))

    return scope


def _recent(m, question, today):
    n, unit = number(m["n"]), UNITS[m["unit"]]
    if n is None or not 1 <= n <= 120 or (m["how"] == "前" and unit == "quarter" and "个" not in m[0]):
        return None  # the first n quarters of a year are not the last n
    return recent(unit, n, today)


STEP = "(?P<step>" + "|".join(sorted(STEPS, key=len, reverse=True)) + ")"
RULES = [
    (re.compile(YEAR + r"\s*" + QUARTER), _quarter),
    (re.compile(r"(?<![\d前])(?:第\s*)?(?P<cn>[一二三四1-4])\s*季度(?P<q>)"), _quarter),
    (re.compile(r"(?<![0-9A-Za-z前])(?P<cn>)[Qq](?P<q>[1-4])(?![0-9A-Za-z])"), _quarter),
    (re.compile(STEP + r"\s*(?:个\s*)?(?:季度|季)"), _step("quarter")),
    (re.compile("(?:" + YEAR + r")?\s*(?P<half>[上下])\s*半年"), _half),
    (re.compile(r"(?P<how>近|最近|过去|前)\s*(?P<n>[0-9]+|[一二三四五六七八九十两]+)\s*个?\s*(?P<unit>月|季度|年)"), _recent),
    (re.compile(STEP + r"(?:个)?月"), _step("month")),
    (re.compile("(?P<rel>" + "|".join(YEARS) + r")(?!\s*年?\s*[0-9一二三四五六七八九十])"), lambda m, q, today: period("year", date(_year(m, q, today), 1, 1))),
]


def scopes(question: str | None, today: date) -> list[Scope]:
    """The time scopes that a question names, in their order: of phrases that overlap the longest counts, a scope named twice is one."""
    found = []
    for pattern, build in RULES:
        for m in pattern.finditer(question or ""):
            scope = build(m, question, today)
            if scope is not None:
                found.append((m.start(), m.end(), Scope(*scope, m[0].strip())))
    taken: list[tuple[int, int, Scope]] = []
    for start, end, scope in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if all(end <= s or start >= e for s, e, _ in taken):
            taken.append((start, end, scope))
    return list({(s.start, s.end, s.text): s for _, _, s in sorted(taken, key=lambda x: x[0])}.values())


def has_time(text: Column) -> Column:
    """Whether a text names a time, as a column."""
    words = "|".join([*YEARS, "半年", "季度", "本月", "上月", "上个月", "这个月"])
    return F.coalesce(text.rlike(rf"(?<!\d)(?:19|20)\d{{2}}(?!\d)|(?:{words})|(?<![0-9A-Za-z])[Qq][1-4](?![0-9A-Za-z])|(?:近|最近|过去)\s*[0-9一二三四五六七八九十两]+\s*个?\s*(?:月|季度|年|天|周)"), F.lit(False))


def fill(template: str, question: str, column: str, today: date, placeholder: str = "{time_scope}") -> str:
    """A condition with its placeholder replaced by the question's scope over a column, in parentheses."""
    if placeholder not in template:
        return template
    found = scopes(question, today)
    if not found:
        raise CompileError("TIME_SCOPE_UNPARSED", question)
    parts = [f"{column} >= timestamp'{s.start}' and {column} < timestamp'{s.end}'" for s in found]
    return template.replace(placeholder, "(" + " or ".join(f"({p})" for p in parts) + ")")


def top_n(text: Column) -> Column:
    """The n of "top n", "前 n" or "限 n", at most MOST_ROWS; null without one."""
    n = F.nullif(F.regexp_extract(F.lower(text), r"(?:top|前|限)\s*([0-9]{1,9})", 1), F.lit("")).cast("int")
    return F.when(n > MOST_ROWS, MOST_ROWS).otherwise(n)


def superlative(text: Column) -> Column:
    """Whether a text asks for an extreme, which implies a ranking."""
    return F.coalesce(F.lower(text).rlike("|".join(SUPERLATIVES)), F.lit(False))


#: The marks that begin a step of a question.
STEP_MARKS = r"(?:第[一二三四五六七八九十0-9]+步|首先|其次|然后|接着|最后|first|then|next|finally)"


def steps(text: Column) -> Column:
    """array<string>: the steps that a text names, without their marks; a clause before the first mark leads the first step. One step without marks."""
    parts = F.transform(F.split(text, f"(?i)[,，;；。.]?\\s*\\b?{STEP_MARKS}[,，:：]?\\s*"), lambda x: F.trim(F.regexp_replace(x, "[,，;；。.]+$", "")))
    kept = F.filter(parts, lambda x: x != "")
    leads = (F.get(parts, F.lit(0)) != "") & (F.size(kept) > 1)
    joined = F.concat(F.array(F.concat_ws(" ", F.get(kept, F.lit(0)), F.get(kept, F.lit(1)))), F.slice(kept, 3, F.greatest(F.size(kept) - 2, F.lit(0))))
    return F.when(leads, joined).otherwise(kept)
