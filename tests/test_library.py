from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sets, stats, text
from sparkloom.operators import dq, features, vectors
from sparkloom.plans import query_plan as Q
from sparkloom.plans.steps import run_steps
from sparkloom.semantic import timescope
from sparkloom.semantic.model import CompileError, Measure, Metric, compute, measure, star, value
from sparkloom.sources import tables


def test_time_scopes():
    assert timescope.period("quarter", date(2024, 5, 9)) == (date(2024, 4, 1), date(2024, 7, 1))
    assert timescope.recent("month", 3, date(2024, 1, 31)) == (date(2023, 11, 1), date(2024, 2, 1))
    assert timescope.recent("year", 1, date(2024, 1, 31)) == (date(2024, 1, 1), date(2025, 1, 1))
    assert timescope.trailing_inclusive(3, date(2024, 2, 5)) == date(2023, 11, 1)
    with pytest.raises(ValueError):
        timescope.recent("month", 121, date(2024, 1, 1))


def test_join_paths(spark, small):
    c = star(spark, small)
    assert [j.right for j, _ in c.path("order", "region")] == ["customer", "nation", "region"]
    with pytest.raises(CompileError, match="LEFT_JOIN_REVERSED"):
        c.joined("supplier", ["line"])
    with pytest.raises(CompileError, match="NO_JOIN_PATH"):
        c.path("line", "elsewhere")
    assert c.physical("line.quantity") == "l_quantity"
    with pytest.raises(CompileError, match="AMBIGUOUS_COLUMN"):
        c.physical("name")


@pytest.mark.parametrize(("metric", "reason"), [
    (Metric("m", "DERIVED", Measure("sum", "x")), "UNSUPPORTED_METRIC"),
    (Metric("m", "RATIO", Measure("sum", "x")), "MISSING_DENOMINATOR"),
    (Metric("m", "MEASURE", Measure("sum")), "MISSING_EXPR"),
    (Metric("m", "MEASURE", Measure("mode", "x")), "UNSUPPORTED_AGG"),
    (Metric("m", "RATIO", Measure("sum", "x"), Measure("sum", "y"), "OTHER"), "UNSUPPORTED_ORDER"),
])
def test_metric_reasons(spark, metric, reason):
    with pytest.raises(CompileError) as e:
        value(metric)
    assert e.value.reason == reason


def test_metric_needs_a_base_and_a_time_column(spark, small):
    with pytest.raises(CompileError, match="NO_BASE_CLASS"):
        compute(star(spark, small), Metric("m", "MEASURE", Measure("count")))
    with pytest.raises(CompileError, match="NO_TIME_COLUMN"):
        compute(star(spark, small), Metric("m", "MEASURE", Measure("count", table="order")), ("2000-01-01", "2001-01-01"))


def test_average_of_ratios_is_not_the_ratio_of_sums(spark):
    rows = [("S001", 100.0, 80.0), ("S001", 200.0, 160.0), ("S002", 150.0, 45.0), ("S002", 50.0, 15.0), ("S003", 300.0, 300.0), ("S004", 0.0, 0.0), ("S005", 100.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, p double, r double")
    n, d = Measure("sum", "r"), Measure("sum", "p")
    got = df.agg(value(Metric("a", "RATIO", n, d, "AVG_OF_RATIOS")).alias("a"), value(Metric("w", "RATIO", n, d)).alias("w")).first()
    assert got["a"] == pytest.approx((0.8 + 0.8 + 0.3 + 0.3 + 1 + 0) / 6) and got["w"] == pytest.approx(600 / 900)
    assert df.agg(measure(Measure("sum", "p", "s = 'S001' or s = 'S002'")).alias("x")).first()["x"] == 500


def test_plans_drop_broken_parts():
    plan, drops = Q.from_dict({"table": "line", "columns": ["a", 3], "conditions": "x", "aggregations": [{"alias": "n"}, {"alias": "n", "function": "count"}], "sort": [{"column": "a", "order": "up"}], "rowLimit": True, "perGroupLimit": "5"})
    assert plan.columns == ("a",) and len(plan.aggregations) == 1 and plan.row_limit is None and plan.per_group_limit == 5
    assert sum(drops.values()) == 4
    assert Q.from_dict({})[0] is None
    assert [Q.limit_of(x) for x in (5, "7", True, 0, -1, "x", None)] == [5, 7, None, None, None, None, None]
    assert Q.from_dict({"table": "t", "rowLimit": 5, "perGroupLimit": 2})[0].row_limit is None


def test_scope_limit():
    p = Q.Plan("t", row_limit=10)
    assert Q.scope_limit(p, False, True).row_limit is None
    assert Q.scope_limit(p, True, True).row_limit == 10
    assert Q.scope_limit(Q.Plan("t"), False, False).row_limit == Q.MOST_ROWS
    with pytest.raises(CompileError):
        Q.refine(p, "a", "like", "1")


def test_truncated(spark):
    rows, more = Q.truncated(spark.range(5), 3)
    assert len(rows) == 3 and more
    assert Q.truncated(spark.range(3), 3)[1] is False


def test_steps_are_bounded(spark):
    with pytest.raises(ValueError):
        run_steps(spark, {}, [])


def test_merge_twice_is_merge_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = tables.merge(t, s, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c")] == sorted(map(tuple, tables.merge(once, s, ["k"]).collect()))


def test_undecided_rules(spark):
    df = spark.createDataFrame([("1,200",), ("x",), (None,)], "v string")
    c = F.col("v")
    got = df.select(dq.undecided(c, ">", F.lit(1000)).alias("a"), dq.undecided(c, "=", F.lit(" x ")).alias("b"), dq.undecided(c, "NOT IN", ["x"]).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (None, True, False), (None, None, None)]


def test_rule_parameters():
    assert dq.condition("range", "a", low=1, high=None) == "a >= 1"
    assert dq.condition("in_set", "a", values=["x'y", 2]) == "a in ('x\\'y', 2)"
    with pytest.raises(ValueError):
        dq.condition("not_null", "a; drop")
    with pytest.raises(ValueError):
        dq.condition("compare", "a", operator="~", value=1)


def test_empty_table_has_rate_0(spark):
    df = spark.createDataFrame([], "a int")
    r = dq.evaluate({"t": df}, [dq.Rule("r", "COMPLETENESS", "t", "a")]).first()
    assert (r["total"], r["pass_rate"], r["status"]) == (0, 0.0, "FAIL")


def test_risk_decisions(spark):
    df = spark.createDataFrame([("LOW", "MEDIUM", False), (None, None, True), (None, None, False), (None, "HIGH", False)], "a string, b string, m boolean")
    got = [r[0] for r in df.select(features.decision(F.lit(None).cast("string"), [F.col("a"), F.col("b")], F.col("m"))).collect()]
    assert got == ["MEDIUM", "UNKNOWN", "LOW", "HIGH"]


def test_feature_upsert_keeps_the_last(spark):
    day = F.lit("2024-01-01").cast("date")
    make = lambda v: features.feature(spark.createDataFrame([("s", v)], "k string, v double"), "f", "k", F.col("v"), day)
    assert [r["value"] for r in features.upsert(make(1.0), make(2.0)).collect()] == [2.0]


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in df.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.3333]


def test_score_of_distances(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (float("nan"),), (None,)], "d double")
    assert [r[0] for r in df.select(vectors.score(F.col("d"))).collect()] == [1.0, 0.25, 0.0, 0.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("ＡＢ１ 中文abcd", "orderLine_id", "约 1,200 与 3万 5%")], "a string, b string, c string")
    r = df.select(text.nfkc(F.col("a")).alias("n"), text.identifier_words(F.col("b")).alias("w"), text.scaled_amounts(F.col("c")).alias("x"), text.token_estimate(F.lit("中文abcd")).alias("t")).first()
    assert r["n"] == "AB1 中文abcd" and r["w"] == ["order", "line", "id"] and r["x"] == [1200.0, 30000.0, 0.05] and r["t"] == 3


def test_chart_kinds():
    assert stats.chart_kind(1, 1, 1, 1.0, False, False) == "number"
    assert stats.chart_kind(10, 5, 2, 0.9, False, False) == "heatmap"
    assert stats.chart_kind(5, 5, 1, 1.0, False, True) == "pie"
    assert stats.chart_kind(20, 20, 1, 1.0, False, False) == "horizontal_bar"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
