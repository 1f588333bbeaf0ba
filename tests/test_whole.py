"""Queries over their whole input, against brute force on small tables."""

import tempfile
from itertools import combinations

from sparkloom import catalogue
from sparkloom.operators import vectors

REGISTRY = catalogue.load()


def folder(spark, **tables):
    """A new folder with the given tables: (schema, rows) by name."""
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def rows(spark, name, d):
    return sorted(tuple(r) for r in REGISTRY.queries[name](spark, d).collect())


def test_graphs_take_lines_of_every_quantity(spark):
    lines = [(o, s, float((7 * o + s) % 50 + 1)) for o in range(12) for s in {o % 5, o * o % 7, 3 * o % 11}]
    d = folder(spark, lineitem=("l_orderkey long, l_suppkey long, l_quantity double", lines), supplier=("s_suppkey long, s_nationkey int", [(s, s % 3) for s in range(12)]))
    by_order = {}
    for o, s, _ in lines:
        by_order.setdefault(o, set()).add(s)
    edges = sorted({e for x in by_order.values() for e in combinations(sorted(x), 2)})
    near = {s: {x for e in edges for x in e if s in e} - {s} for s in range(12)}
    assert rows(spark, "graph_degree", d) == [(s, len(x)) for s, x in near.items() if x]
    assert rows(spark, "graph_gaps", d) == [(s, len(x)) for s, x in near.items() if len(x) <= 1]
    assert rows(spark, "graph_surprising", d) == [e for e in edges if e[0] % 3 != e[1] % 3]
    two = {y for x in near[1] for y in near[x]} - near[1] - {1}
    assert rows(spark, "graph_hops_2", d) == sorted([(x, 1) for x in near[1]] + [(x, 2) for x in two])
    assert [(a, b, len(near[a] & near[b])) for a, b in edges] == [r[:3] for r in rows(spark, "graph_adamic_adar", d)]


def test_more_queries_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 7)
    points = {i: [float(i * i % 37), float(i * 5 % 23)] for i in range(60)}
    v = spark.createDataFrame(list(points.items()), "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rn"]): r["vec_id"] for r in vectors.top_k(v, v.filter("vec_id % 3 = 0"), 4).collect()}
    near = {q: sorted((sum((x - y) ** 2 for x, y in zip(points[q], p)), i) for i, p in points.items()) for q in range(0, 60, 3)}
    assert got == {(q, n): near[q][n - 1][1] for q in near for n in range(1, 5)}


def test_questions_are_whole_texts(spark):
    turns = [(1, 0, "user", "How many parts?"), (2, 0, "user", " how many PARTS? "), (3, 0, "user", "How many orders?"), (4, 0, "assistant", "How many orders?"), (5, 0, "user", None), (6, 0, "user", None)]
    d = folder(spark, conversations=("conv_id long, turn long, role string, text string", turns))
    assert rows(spark, "question_promotion", d) == [("how many parts?", 2, 1)]


def test_titles_are_whole(spark):
    long = "The yearly report on the deliveries of all suppliers"
    html = [f"<title>{long} 2024</title>", f"<html><TITLE lang='en'>{long.upper()}:\n2024</TITLE>", f"<title>{long} 2025</title>", "<title> </title>", "<title></title>", "<p>none</p>", None]
    d = folder(spark, pages=("page_id long, url string, html string", [(i, "", h) for i, h in enumerate(html)]))
    assert rows(spark, "doc_title_overlap", d) == [("theyearlyreportonthedeliveriesofallsuppliers2024", 2)]


def test_every_identifier_divisible_by_20_is_searched(spark):
    d = folder(spark, embeddings=("vec_id long, embedding array<float>, label int", [(i, [float(i * i % 97), float(i % 13)], i % 5) for i in range(130)]))
    for name, labels in (("vec_topk_l2", range(5)), ("vec_filtered_topk", (1, 3))):
        got = {(r["query_id"], r["rn"]): r["vec_id"] for r in REGISTRY.queries[name](spark, d).collect()}
        for q in range(0, 130, 20):
            near = sorted(((q * q % 97 - i * i % 97) ** 2 + (q % 13 - i % 13) ** 2, i) for i in range(130) if i % 5 in labels)
            assert [got.pop((q, n)) for n in range(1, 6)] == [i for _, i in near[:5]]
        assert not got
