"""Guards of metrics, time phrases, plans by name, tables kept in step, streams that start again."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import matching as M, retrieval as R
from sparkloom.operators import dq, graph, knowledge as K
from sparkloom.plans import query_plan as Q, steps
from sparkloom.semantic import kpi, timephrases as T
from sparkloom.semantic.model import CompileError, Measure, Metric, star
from sparkloom.sources import shared, sync
from sparkloom.streaming import streams as S

ONE, TWO = Measure("sum", "o_totalprice"), Measure("sum", "c_acctbal")


@pytest.mark.parametrize(("metric", "sources", "reason"), [
    (Metric("m", "MEASURE", ONE), [], "MEASURE_CLASS_UNRESOLVED"),
    (Metric("m", "MEASURE", ONE), [kpi.Source("a", "NUMERATOR"), kpi.Source("b", "NUMERATOR")], "MEASURE_CLASS_UNRESOLVED"),
    (Metric("m", "RATIO", ONE, TWO), [kpi.Source("a", "NUMERATOR"), kpi.Source("b", "BASE")], "MEASURE_CLASS_UNRESOLVED"),
    (Metric("m", "MEASURE", ONE), [kpi.Source("a", "BASE"), kpi.Source("b", "FILTER")], "FILTER_SOURCE_UNSUPPORTED"),
    (Metric("m", "RATIO", Measure("sum", "x * y"), TWO), [kpi.Source("a", "NUMERATOR"), kpi.Source("b", "DENOMINATOR")], "EXPR_CROSS_TABLE_UNSUPPORTED"),
])
def test_what_would_inflate_a_metric_is_refused(metric, sources, reason):
    with pytest.raises(CompileError) as e:
        kpi.guarded(metric, sources)
    assert e.value.reason == reason


def test_sources_name_the_tables_of_measures():
    sources = [kpi.Source("order", "numerator "), kpi.Source("customer", "DENOMINATOR"), kpi.Source("customer", "FILTER"), kpi.Source("line", "BASE")]
    metric, warnings = kpi.guarded(Metric("m", "RATIO", ONE, TWO, grain=("g",)), sources, ("g", "h"))
    assert (metric.numerator.table, metric.denominator.table, metric.base, warnings) == ("order", "customer", "order", ["GRAIN_KEYS_IGNORED"])
    assert kpi.guarded(Metric("m", "MEASURE", ONE), [kpi.Source("line", "BASE")])[0].base == "line"


def test_columns_of_formulas():
    known = ["qty", "price", "total", "cost"]
    assert kpi.columns_of("sum(t.qty * PRICE) / nullif(sum(total), 0) || 'cost'", known) == ["qty", "price", "total"]
    assert kpi.denominator_gaps("sum(qty) / nullif(sum(total), 0)", ["total"], known) == []
    assert kpi.denominator_gaps("sum(total) / 2", ["total", "qty"], known) == ["total", "qty"]


def test_imported_tables(spark):
    df = spark.createDataFrame([("orders",), ("TMP_x",), ("#t",), ("Log",)], "table string")
    assert [r[0] for r in kpi.imported(df, ["log"]).collect()] == ["orders"]


def test_slice_metrics(spark):
    metrics = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c")], "metric string, class string")
    assert [r[0] for r in kpi.slice_metrics(metrics, spark.createDataFrame([("a",), ("b",)], "name string")).collect()] == ["m1"]


TODAY = date(2026, 11, 15)


@pytest.mark.parametrize(("question", "want"), [
    ("2026年第三季度和去年Q1", ["2026-07-01/2026-10-01", "2025-01-01/2025-04-01"]),
    ("今年一季度", ["2026-01-01/2026-04-01"]), ("上个季度", ["2026-07-01/2026-10-01"]), ("2025年收入，一季度呢", ["2025-01-01/2025-04-01"]),
    ("去年下半年", ["2025-07-01/2026-01-01"]), ("近6个月", ["2026-06-01/2026-12-01"]), ("最近三个月", ["2026-09-01/2026-12-01"]), ("前三季度", []), ("前3个季度", ["2026-04-01/2027-01-01"]),
    ("上个月", ["2026-10-01/2026-11-01"]), ("今年销售额", ["2026-01-01/2027-01-01"]), ("去年12月", []), ("Q2", ["2026-04-01/2026-07-01"]), ("近99999个月", []), ("2026-Q2", ["2026-04-01/2026-07-01"]),
    ("13季度", []), ("近十二个月", ["2025-12-01/2026-12-01"]), ("Q1与Q1", ["2026-01-01/2026-04-01"]), ("", []), (None, []), ("下一年", ["2027-01-01/2028-01-01"]),
])
def test_time_phrases(question, want):
    assert [f"{s.start}/{s.end}" for s in T.scopes(question, TODAY)] == want


def test_placeholder():
    assert T.fill("a = 1", "", "d", TODAY) == "a = 1"
    assert T.fill("a = 1 and {time_scope}", "本月", "d", TODAY) == "a = 1 and ((d >= timestamp'2026-11-01' and d < timestamp'2026-12-01'))"
    with pytest.raises(CompileError, match="TIME_SCOPE_UNPARSED"):
        T.fill("{time_scope}", "ever", "d", TODAY)


def test_plans_by_name(spark, small):
    c = star(spark, small)
    assert Q.from_dict({"table": "无法回答"})[0] is None
    plan, _ = Q.from_dict({"table": "customer", "columns": ["name", "acctbal"], "sort": [{"column": "acctbal", "order": "desc"}], "nulls": "small"})
    assert Q.named(c, plan).columns == ("c_name", "c_acctbal") and Q.named(c, plan).sort == (("c_acctbal", "desc"),) and plan.nulls == "small"
    assert Q.between(plan, "d", "2024-02-30", "2024-03-01") == plan == Q.between(plan, "d", "2024-03-02", "2024-03-01")
    assert Q.equality("a.x = b.y") == ("a.x", "b.y") and Q.equality("a >= b") is None and Q.equality("a = b = c") is None and Q.equality("a =") is None
    assert Q.hints(c, "quantty")[0] == "line.l_quantity" or "line.quantity" in Q.hints(c, "quantty")
    assert Q.hints(c, "wrong.quantity") == ["line.quantity"] and Q.hints(c, "月") == ["date_trunc('month', a date column)"]
    with pytest.raises(CompileError, match="UNKNOWN_BUCKET"):
        Q.bucket("d", "fortnight")


def test_carried_results(spark):
    assert steps.carried(spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")) == "a, 1\n, 2"
    assert steps.carried(spark.createDataFrame([(1, 2.5)], "x int, y double")) == '[{"x": 1, "y": 2.5}]'
    assert len(steps.carried(spark.range(60).select(F.lit("x" * 100).alias("x")))) == 2000


def test_versions(spark):
    root = shared.path(spark, "versions-test")
    t = sync.Versions(spark, root, "k int, v int")
    assert t.read().count() == 0 and t.number() is None
    sync.upsert(t, spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), ["k"])
    sync.upsert(sync.Versions(spark, root, "k int, v int"), spark.createDataFrame([(2, 5), (3, 3)], "k int, v int"), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, 1), (2, 5), (3, 3)] and t.number() == 1
    assert t.write(spark.createDataFrame([(9, 9)], "k int, v int"), 0) == 1 and t.read().count() == 3


def events(spark, folder, name, rows):
    df = spark.createDataFrame(rows, S.EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    df.write.mode("append").parquet(str(folder / f"{name}.parquet"))


def test_streams_start_again_and_drop_what_is_late(spark, tmp_path):
    schema = S.EVENTS
    row = lambda i, ts, user: (i, ts, user, "view", 1.0, "{}")
    first, second = tmp_path / "a", tmp_path / "b"
    events(spark, first, "events", [row(1, "2024-01-01 00:00:00", 1), row(2, "2024-01-02 00:00:00", 2)])
    root = shared.path(spark, "stream-test")
    read = lambda folder: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder)).select("user_id", "ts", "event_id")
    assert sorted(r["event_id"] for r in S.upsert_batches(read(first), ["user_id"], "ts", "x", root).collect()) == [1, 2]
    events(spark, first, "more", [row(3, "2024-01-03 00:00:00", 1), row(4, "2024-01-01 00:00:00", 2)])
    assert sorted(r["event_id"] for r in S.upsert_batches(read(first), ["user_id"], "ts", "x", root).collect()) == [2, 3]
    # a row that comes after its window has closed is not counted
    events(spark, second, "e1", [row(1, "2024-01-01 00:10:00", 1), row(2, "2024-01-05 00:10:00", 1)])
    events(spark, second, "e1b", [row(5, "2024-01-05 00:20:00", 1)])
    events(spark, second, "e2", [row(3, "2024-01-01 00:20:00", 1), row(4, "2024-01-09 00:10:00", 1)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(second))
    got = {str(r["start"]): r["n"] for r in S.drained(S.tumbling(stream, "1 hour"), "append", "late").collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-05 00:00:00": 2}


def test_an_empty_source_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(S.EVENTS).parquet(str(tmp_path / "none"))
    assert S.drained(S.tumbling(stream, "1 hour"), "append", "nothing").count() == 0


def test_terms_with_ideographs_and_short_ones(spark):
    texts = spark.createDataFrame([(1, "上月采购订单金额"), (2, "Orders by purchase"), (3, None)], "k int, t string")
    terms = spark.createDataFrame([("A", "采购", 3), ("A", "采购订单", 4), ("B", "PurchaseOrders", 3), ("C", "order", 3), ("D", "o", 9)], "code string, term string, weight int")
    got = {(r["k"], r["code"]): r["score"] for r in R.term_scores(texts, "k", "t", terms).collect()}
    assert got == {(1, "A"): 7, (2, "B"): 2, (2, "C"): 3}


def test_thresholds_that_need_no_common_word_are_refused(spark):
    catalogue = spark.createDataFrame([("K", ["a"], 0.0)], "code string, keywords array<string>, threshold double")
    with pytest.raises(ValueError):
        M.keyword_match(spark.createDataFrame([(1, "a")], "k int, t string"), "k", F.split("t", " "), catalogue)


def test_chunks_flush_at_pages_and_cut_long_blocks(spark):
    rows = [(1, 0, 1, "a" * 300), (1, 1, 1, "b" * 199), (1, 2, 1, "c"), (1, 3, 2, "d"), (1, 4, 2, "e" * 920), (1, 5, None, "f"), (1, 6, 3, "g"), (2, 0, None, "")]
    got = {(r["k"], r["chunk_no"]): (r["page"], r["block_no"], r["chunk"]) for r in K.chunks(spark.createDataFrame(rows, "k int, block_no long, page long, block string"), "k").collect()}
    assert got == {
        (1, 0): (1, 0, "a" * 300 + "\n" + "b" * 199), (1, 1): (1, 2, "c"), (1, 2): (2, 3, "d"), (1, 3): (2, 4, "e" * 500), (1, 4): (2, 4, "e" * 470), (1, 5): (2, 4, "e" * 20), (1, 6): (None, 5, "f\ng"), (2, 0): (None, 0, ""),
    }


def test_scores_leave_errors_out(spark):
    frames = {"t": spark.createDataFrame([(1,), (None,)], "x int")}
    rules = [dq.Rule("a", "COMPLETENESS", "t", "x"), dq.Rule("b", "COMPLETENESS", "t", "y"), dq.Rule("c", "TIMELINESS", "t", "x"), dq.Rule("d", "UNIQUENESS", "t", "x")]
    got = {(r["table_name"], r["kind"]): r["score"] for r in dq.scores(dq.evaluate(frames, rules)).collect()}
    assert got["t", "COMPLETENESS"] == 50 and got["t", "TIMELINESS"] is None and got["t", "OVERALL"] == 50 and got["*", "UNIQUENESS"] == 50
    assert dq.evaluate(frames, rules[1:3]).count() == 2


def test_empty_texts_have_no_slices(spark):
    from sparkloom.functions.text import slices

    assert slices(spark.createDataFrame([(1, ""), (2, None), (3, "abc")], "k int, t string"), "k", "t").count() == 1


def test_sync_of_vectors_and_retention(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")])], "k int, v array<double>")
    assert [r["k"] for r in sync.vector_rows(v, "k", "v", 2).collect()] == [1]
    rows = spark.createDataFrame([(1, 10), (1, 99), (2, 10), (3, None)], "p int, age int")
    kept = sync.retained(rows, spark.createDataFrame([(1, True), (2, False)], "p int, gone boolean"), "p", F.col("gone"), F.col("age") < 50)
    assert sorted((r["p"], r["age"]) for r in kept.collect() if r["age"]) == [(1, 99), (2, 10)] and kept.count() == 3


def test_graph_release_keeps_no_edge_without_ends(spark):
    nodes, edges = sync.graph_release(spark.createDataFrame([(1,), (1,), (2,)], "node int"), spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "a int, b int"), "r")
    assert nodes.count() == 2 and [(r["a"], r["b"], r["release_id"]) for r in edges.collect()] == [(1, 2, "r")] and graph.degrees(edges).count() == 2
