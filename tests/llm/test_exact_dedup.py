from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup as E

ROWS = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, None), (5, "", "z"), (6, "A", "q"), (7, "a", "x"), (8, "x" * 300_000, ""), (9, "x" * 300_000, "")]
SCHEMA = "doc_id long, text string, __digest string"


def brute(rows, keep):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    best = max if keep == "max" else min
    return {i: (best(g), len(g), i == best(g)) for g in groups.values() for i in g}


def got(df, keep, **more):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_groups(df, keep=keep, **more).collect()}


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for keep in ("max", "min"):
        assert got(df, keep) == brute(ROWS, keep)


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = lambda c: F.encode(F.char_length(c).cast("string"), "UTF-8")
    for keep in ("max", "min"):
        assert got(df, keep, digest=weak) == brute(ROWS, keep)


def test_empty_table_and_kept_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert E.exact_groups(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in E.drop_exact(df, keep="max").collect()) == [2, 5, 6, 7, 9]
    assert E.drop_exact(df).columns == df.columns


def test_index_takes_batches_in_and_finds_what_it_holds(spark):
    import hashlib
    import random

    rnd = random.Random(3)
    index, seen = E.Index(spark, "max"), {}
    for batch in range(5):
        rows = [(batch * 1000 + i, rnd.randrange(900)) for i in range(300)]
        df = spark.createDataFrame(rows, "__id long, k int").select(E.sha256_bytes(F.col("k").cast("string")).alias("__digest"), "__id").repartition(3)
        hits = {bytes(r[0]) for r in index.absorb(df).collect()}
        before = set(seen)
        for i, k in rows:
            seen.setdefault(hashlib.sha256(str(k).encode()).digest(), []).append(i)
        new = [hashlib.sha256(str(k).encode()).digest() for _, k in rows]
        assert hits == {d for d in new if d in before or new.count(d) > 1}
        assert [t.tier for t in index.tables] == [[0], [1], [1, 0], [2], [2, 0]][batch]
    asked = spark.createDataFrame([(bytearray(d),) for d in list(seen)[:50]] + [(bytearray(b"none"),)], "__digest binary")
    found = {}
    for r in index.lookup(asked).collect():
        best, n = found.get(bytes(r["__digest"]), (-1, 0))
        found[bytes(r["__digest"])] = max(best, r["__keep"]), n + r["__n"]
    assert found == {d: (max(seen[d]), len(seen[d])) for d in list(seen)[:50]}


def test_filters_let_all_they_hold_and_little_else_through(spark):
    rows = spark.range(20_000).select(E.sha256_bytes(F.col("id").cast("string")).alias("__digest"), "id")
    held, blocks = rows.filter("id < 8000"), 4
    through = {r["id"] for r in E.passing(rows, E.make_filter(held, blocks), blocks).collect()}
    assert set(range(8000)) <= through and len(through) < 8000 + 12_000 * 0.04


def test_repeated_identifiers_lose_no_text(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (5, "x", "p"), (5, "x", "q"), (5, "x", "q"), (None, "a", "n"), (None, "a", "n")]
    for keep, want in (("max", [(1, "b"), (2, "a"), (5, "x")]), ("min", [(1, "a"), (1, "b"), (5, "x")])):
        out = E.drop_exact(spark.createDataFrame(rows, SCHEMA), keep=keep).collect()
        assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None) == want
        assert sum(r["doc_id"] is None for r in out) == 2
