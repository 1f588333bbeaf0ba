import random

import numpy as np
import pytest

from sparkloom.llm import ngram_join as J
from tests.llm import brute

SCHEMA = "doc_id long, text string, component_id string, tokens string"


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_groups(df).collect()}
    assert got == brute.near_groups(rows)
    return got


def test_test_table(spark, small):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_groups_of_all_sizes(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    rows = []

    def put(w):
        rows.append((len(rows) * 3 + 1, " ".join(w)))

    for size in (2, 3, 8, 40):  # near copies with rising numbers of changes
        base = [r.choice(words) for _ in range(r.randint(40, 160))]
        for k in range(size):
            w = list(base)
            for _ in range(k % 9):
                w[r.randrange(len(w))] = r.choice(words)
            put(w)
    for _ in range(60):  # a passage that many documents share, in short and long ones
        n = r.choice([3, 8, 15, 60])
        put([r.choice(words) for _ in range(n)] + passage)
    for _ in range(30):  # exact copies, and copies in another case
        put(["Same", "text", "again", "and", "again", "here"])
        put(["same", "TEXT", "again", "and", "again", "here"])
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two three four"), (5006, "one  two\tthree\nfour"), (5007, "É one"), (5008, "é one"), (5009, "word " * 20_000), (5010, "word " * 30_000)]
    got = check(spark, rows)
    assert got[5003] == (1, 5003) and got[5004] == (1, 5003) and got[5006] == (1, 5005) and got[5008] == (1, 5008) and got[5010] == (1, 5009)


def test_null_identifiers_empty_tables_and_kept_rows(spark):
    text = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(None, text, "", ""), (2, text, "", ""), (1, text + " q", "", ""), (3, "z", "", "")], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_groups(df).collect()}
    assert got == {None: (None, None), 2: (12, 1), 1: (13, 1), 3: (1, 3)}
    kept = J.drop_near(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]
    assert J.near_groups(df.limit(0)).count() == 0


def test_hashes_follow_the_words():
    texts = ["a b c d e f", "A  b\tc d e f", "", None, "x", "b a c d e f", "a b c d e"]
    sets = [s.tolist() for s in J.shingle_sets(texts)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] == sets[3] == [] and len(sets[4]) == 1
    assert not set(sets[5]) & set(sets[0]) and set(sets[6]) < set(sets[0])


@pytest.mark.parametrize("seed", range(20))
def test_marks_survive_packing(seed):
    marks = np.random.default_rng(seed).integers(0, 2**32, seed * 50 + 1, dtype=np.uint32)
    assert (J._from_planes(J._planes(marks)) == np.sort(marks)).all()
    tokens = np.random.default_rng(seed).integers(0, 2**64, seed * 50, dtype=np.uint64)
    assert (J._from_planes(J._planes(tokens), np.uint64) == np.sort(tokens)).all()


@pytest.mark.parametrize("n", range(1, 60))
def test_prefixes_are_long_enough(n):
    for m in range(n, n * 4 // 3 + 1):
        least = -(-3 * (n + m) // 7)  # the smallest overlap that links sizes n and m
        if least <= n:
            assert J._index_size(n, 3, 4) >= n - least + 1 and J._prefix_size(m, 3, 4) >= m - least + 1


def test_a_passage_of_many_documents_makes_no_more_pairs_than_documents(spark):
    """Documents with 120 words of their own around a passage of 64: the passage's tokens come last, so none is a first token."""
    for m in (200, 400):
        rows = [(i, " ".join([f"d{i}a{k}" for k in range(60)] + [f"p{k}" for k in range(64)] + [f"d{i}b{k}" for k in range(60)])) for i in range(m)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert J._first_tokens(df, "doc_id", "text", 8, 3, 4).filter("kind <> 0").isEmpty()


def test_components_of_stars_and_chains(spark, monkeypatch):
    from sparkloom.llm import graph_components as C

    monkeypatch.setattr(C, "HEAVY", 5)
    edges = [(1, i) for i in range(10, 40)] + [(50, i) for i in range(60, 90)] + [(39, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [1, 50, *range(10, 40), *range(60, 90)]} == {1} and {got[i] for i in range(100, 141)} == {100} and len(got) == 62 + 41
