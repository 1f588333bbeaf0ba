import zlib

from sparkloom.llm import quality as Q, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in known)
    assert len(known) > 50 and right / len(known) >= 0.95


def test_pairs_are_as_many_as_the_better_documents_in_each_round(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i % 5 > 0)) for i in range(500)], "id long, x array<double>, label int")
    n = Q.pairs(df, rounds=3, bucket_rows=100).count()
    assert n == 3 * 400
    assert all(r["better"][0] % 5 and not r["worse"][0] % 5 for r in Q.pairs(df, 1).collect())


def test_one_label_none_nulls_and_empty(spark):
    schema = "doc_id long, text string, x string, label string"
    docs = spark.createDataFrame([(1, "good words here", "", ""), (2, None, "", ""), (3, "", "", ""), (None, "z", "", "")], schema)
    for labels, want in (([(1, 1)], 1), ([(1, 0)], 0), ([], 1), ([(1, None)], 1)):
        got = Q.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 4 and all((r["score"] >= Q.PASS - 1e-12) == bool(want) for r in got)
    assert Q.scored(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_features():
    assert Q.measure("") == [0.0] * Q.WIDTH
    forms = lambda t: dict(zip(Q.NAMES, Q.measure(t), strict=False))
    a = forms("ABC ABC ABC!! a|b 1")
    assert a["upper"] == 9 / 11 and a["same_neighbours"] == 1 / 5 and a["exclaims"] == 2 / 5 and a["bars"] == 1 / 5
    assert forms("Ééé")["upper"] == 1 / 3
    words = Q.measure("the The cat")[len(Q.NAMES) :]
    assert len(words) == Q.WORD_SLOTS and abs(sum(map(abs, words)) - 3 / 3**0.5) < 1e-9


def test_every_labelled_row_is_in_a_pair_of_each_round(spark):
    for rare in (0, 1):
        df = spark.createDataFrame([(i, [float(i)], rare if i % 100 == 0 else 1 - rare) for i in range(6400)], "id long, x array<float>, label int")
        for rounds in (1, 2):
            rows = Q.pairs(df, rounds).collect()
            assert {r["better"][0] for r in rows} | {r["worse"][0] for r in rows} == {float(i) for i in range(6400)}
            assert len(rows) < rounds * 7000


def test_most_rows_bound_training_and_not_scores(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "|| !! ||") for i in range(2000)], "doc_id long, text string")
    rows = docs.withColumn("x", Q.features(docs["text"])).selectExpr("doc_id as id", "cast(doc_id % 2 as int) as label", "x")
    ranking = Q.fit(rows, most_rows=200)
    got = rows.select("label", ranking.score(rows["x"]).alias("s")).collect()
    assert len(got) == 2000 and all((r["s"] >= Q.PASS) == (r["label"] == 1) for r in got)


def test_scores_follow_from_the_ranking_in_plain_python(spark):
    """The query's scores against weights and cut applied row by row."""
    import math

    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = docs.select(docs["doc_id"].alias("id"), Q.features(docs["text"]).alias("x")).join(Q.training_labels(labels).selectExpr("doc_id as id", "quality as label"), "id")
    ranking = Q.fit(x)
    for r in queries.op8_quality(spark, folder).collect():
        strength = sum(w * v for w, v in zip(ranking.weights, Q.measure(texts[r["doc_id"]] or ""), strict=True))
        want = 1 / (1 + math.exp(-(strength - ranking.cut) - math.log(0.7 / 0.3)))
        assert abs(r["score"] - want) < 1e-3
