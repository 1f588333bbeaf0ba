import corpus_pipeline as C
from sparkloom.llm import pii, quality
from tests.llm import brute
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "ngram_join", "pii", "packing"]
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = C.keep_good(spark, docs, small)
    assert good.columns == docs.columns
    scores = quality.scored(docs, quality.training_labels(spark.read.parquet(f"{small}/labels.parquet")))
    kept = {r["doc_id"] for r in scores.collect() if r["score"] >= quality.PASS}
    assert {r["doc_id"] for r in good.collect()} == kept
    by_text = {}
    for i in sorted(kept):
        by_text[rows[i]] = i
    single = C.drop_copies(spark, good, small)
    assert {r["doc_id"] for r in single.collect()} == set(by_text.values())
    near = brute.near_groups([(i, rows[i]) for i in by_text.values()])
    apart = C.drop_near_copies(spark, single, small)
    assert {r["doc_id"] for r in apart.collect()} == {i for i, (_, c) in near.items() if i == c} and apart.columns == docs.columns
    hidden = C.hide_personal(spark, apart, small)
    assert hidden.columns == docs.columns
    new = {r["doc_id"]: r for r in hidden.collect()}
    want = {r["doc_id"]: r["text"] for r in pii.pseudonymise(apart, C.PSEUDONYM_KEY).collect()}
    assert {i: r["text"] for i, r in new.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in new.items() if r["text"] != rows[i])
    out = C.pack_bins(spark, hidden, small).collect()
    check({i: (len(r["text"].encode()), r["source"], r["text"]) for i, r in new.items()}, out, C.CAPACITY_BYTES)
    assert sorted(map(tuple, C.run(spark, small).collect())) == sorted(map(tuple, out))


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 20")
    nulls = spark.createDataFrame([(None, None, None, None, None), (900, None, None, None, None), (None, "a b c d e 129.38.82.176", None, None, None)], docs.schema)
    clash = "gone_id found new __x x id a n_replaced component_id keep_id digest tokens size piece bin_id score label".split()
    docs = docs.unionByName(nulls).withColumns({c: F.lit("kept") for c in clash})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        assert all(r[c] == "kept" for r in out.select(*clash).collect() for c in clash), name
    whole = {(r["doc_id"], r["text"]) for r in C.drop_copies(spark, docs, small).select("doc_id", "text").collect()}
    assert {(None, None), (None, "a b c d e 129.38.82.176"), (900, None)} <= whole
    assert {r["doc_id"] for r in C.pack_bins(spark, docs, small).collect()} == {r["doc_id"] for r in docs.collect()}
