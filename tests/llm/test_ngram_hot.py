"""Tokens of many documents: their records are never gathered in one group."""

import random

import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import ngram_join as J
from tests.llm import brute


def near_copies():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for size, length in ((90, 70), (40, 75), (30, 200), (3, 20)):
        base = [r.choice(words) for _ in range(length)]
        for k in range(size):
            w = list(base)
            for _ in range(k % 8):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(w)
    passage = [f"p{i}" for i in range(60)]
    texts += [[r.choice(words) for _ in range(r.choice([3, 8, 15, 60]))] + passage for _ in range(60)]
    return [(3 * i + 1, " ".join(w)) for i, w in enumerate(texts)]


def test_hot_tokens_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 10)
    pairs = J._pairs
    # the groups of this test run in worker processes: a part with a hot token's records fails there
    def checked(records, a, b):
        documents = pd.DataFrame({"mark": records["mark"], "node": records["node"]}).drop_duplicates()
        assert not len(documents) or documents["mark"].value_counts().max() <= 10
        return pairs(records, a, b)

    monkeypatch.setattr(J, "_pairs", checked)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.near_groups(rows)


@pytest.mark.parametrize("seed", range(10))
def test_rows_of_a_hot_token_make_the_pairs_of_a_large_group(spark, seed):
    r = np.random.default_rng(seed)
    m = 120
    n, indexed, node = r.integers(5, 90, m), r.random(m) < 0.4, np.arange(m) * 7 + 1
    records = np.zeros(m, dtype=J.RECORD)
    records["mark"], records["n"], records["node"] = 5, n | (indexed * J.INDEXED), node
    want = {(int(x["a"]), int(x["b"])) for x in J._once(J._pairs(records, 3, 4))}
    rank = (J._rank(node) ^ np.uint64(1 << 63)).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"code": 5, "n": n, "indexed": indexed, "node": node, "rank": rank}))
    got = {(x["a"], x["b"]) for x in J._hot_pairs(df.unionByName(df.limit(40)).repartition(3), 3, 4).collect()}
    assert want <= got and len(got) <= J.HUBS * m
