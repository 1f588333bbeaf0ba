from collections import defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import packing as P
from tests.llm import brute

ITEM = st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 6))


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEM, max_size=60))
def test_best_fit(items):
    assert P.best_fit(*([x[i] for x in items] for i in range(3)), 20) == brute.best_fit(items, 20)


def check(rows, out, capacity):
    """rows: doc -> (size, source, cluster); every byte once, no bin over capacity, no source or cluster twice in a bin."""
    spans, bins = defaultdict(list), defaultdict(list)
    for r in out:
        spans[r["doc_id"]].append((r["start"], r["size"]))
        bins[r["bin_id"]].append(r)
    assert set(spans) == set(rows)
    for d, s in spans.items():
        at = 0
        for start, size in sorted(s):
            assert start == at
            at += size
        assert at == rows[d][0]
    for b in bins.values():
        assert sum(r["size"] for r in b) <= capacity
        for k in (1, 2):
            held = [rows[r["doc_id"]][k] for r in b]
            assert len(held) == len(set(held))


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = P.pack(docs, 4096, F.octet_length("text"), F.col("source"), F.xxhash64("text"), shard_rows=64).collect()
    rows = {r["doc_id"]: (len((r["text"] or "").encode()), r["source"], r["text"]) for r in docs.collect()}
    check(rows, out, 4096)


def test_shards_are_packed_as_brute_force_does(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = P.pack(docs, 4096, F.octet_length("text"), F.col("source"), F.xxhash64("text"), shard_rows=100_000).toPandas()
    meta = docs.select("doc_id", "source", "text").toPandas()
    part = out[~out["bin_id"].str.startswith("full")].merge(meta, on="doc_id")
    part = part.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    want = brute.best_fit(list(zip(part["size"], part["source"], part["text"], strict=True)), 4096)
    assert part["bin_id"].tolist() == [f"0-{b}" for b in want]


def test_nulls_ties_long_and_empty(spark):
    schema = "doc_id long, n long, source string, piece string, bin_id string"
    df = spark.createDataFrame([(1, None, None, "", ""), (2, 0, None, "", ""), (3, -5, "a", "", ""), (4, 1_000_003, "a", "", ""), (5, 10, "b", "", ""), (5, 10, "b", "", ""), (None, 3, "c", "", "")], schema)
    out = P.pack(df, 1000, F.col("n"), F.col("source"), F.lit(None).cast("string")).collect()
    assert len(out) == 6 + 1001
    bins = defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append(r)
    assert all(len(b) == 1 for b in bins.values())  # one null cluster holds all
    assert P.pack(df.limit(0), 1000, F.col("n"), F.col("source"), F.col("source")).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, 0, F.col("n"), F.col("source"), F.col("source"))
    assert isinstance(pd.DataFrame(out), pd.DataFrame)


def test_texts_are_cut_between_characters_and_come_back(spark):
    rows = [(1, "aé€😀" * 50, "s"), (2, "😀" * 40, "s"), (3, None, "s"), (4, "", "t"), (5, "x" * 64, "t"), (6, "x" * 65, "t"), (7, "é" * 1000, "u"), (7, "é" * 1000, "u"), (None, "€" * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin_id", F.lit("?"))
    out = P.pack_texts(df, 64, F.col("source"), F.xxhash64("text"), with_text=True)
    got = out.collect()
    assert all(r["size"] == len(r["text"].encode()) <= 64 and "\ufffd" not in r["text"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["text"]))
    assert all("".join(t for _, t in sorted(by[i])) == (text or "") for i, text, _ in rows if i != 7)
    assert len(by[7]) == 2 * len(set(by[7])) and "".join(t for _, t in sorted(set(by[7]))) == "é" * 1000
    held = P.bins(out).collect()
    assert sum(len(b["pieces"]) for b in held) == len(got) and all(b["size"] <= 64 for b in held)
    assert P.pack_texts(df.limit(0), 64, F.col("source"), F.col("source")).count() == 0
