"""Documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import vectors
from sparkloom.sources.tables import read

from . import Registry

query = Registry()


@query(r"""SELECT doc_id, CAST(no - 1 AS INT) AS paragraph_no, length(trim(p)) AS n_chars, sha256(trim(p)) AS hash FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS no FROM documents) WHERE trim(p) <> ''""")
def doc_paragraphs(spark, d):
    return text.paragraphs(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "paragraph_no", F.char_length("paragraph").cast("long").alias("n_chars"), F.sha2("paragraph", 256).alias("hash"))


@query("""SELECT doc_id, CAST(start / 450 AS INT) AS chunk_no, CAST(start AS INT) AS start, sha256(substr(text, start + 1, 500)) AS hash FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS start FROM documents WHERE length(text) > 500)""")
def doc_chunks_long(spark, d):
    rows = text.slices(read(spark, d, "documents").filter(F.char_length("text") > 500), "doc_id", "text")
    return rows.select("doc_id", "chunk_no", "start", F.sha2("chunk", 256).alias("hash"))


@query()
def doc_chunks_packed(spark, d):
    return text.packed_chunks(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_no", F.char_length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("hash"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY text")
def doc_hash_dedup(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(r"SELECT k AS title, count(DISTINCT page_id) AS docs FROM (SELECT page_id, lower(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[^\p{L}\p{N}]', '', 'g')) AS k FROM pages) WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT page_id) > 1")
def doc_title_overlap(spark, d):
    """Whole titles that pages share."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    rows = read(spark, d, "pages").select("page_id", text.title_key(title).alias("title")).filter("title <> ''")
    return rows.groupBy("title").agg(F.count_distinct("page_id").alias("docs")).filter("docs > 1")


TERMS = ["red", "blue", "widget", "ring", "bolt", "small", "sm", "or"]


@query("""WITH t AS (SELECT unnest(['red', 'blue', 'widget', 'ring', 'bolt', 'small', 'sm', 'or']) AS term), m AS (SELECT p_partkey, term, row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, term) AS rn FROM part JOIN t ON contains(lower(p_name), term))
SELECT p_partkey, term FROM m WHERE rn = 1""")
def doc_ngram_anchor(spark, d):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return text.longest_term(read(spark, d, "part"), "p_partkey", F.lower("p_name"), terms)


@query("SELECT p_name, CAST(levenshtein(p_name, 'red widgt') AS INT) AS distance FROM (SELECT DISTINCT p_name FROM part) ORDER BY distance, p_name LIMIT 3")
def doc_edit_distance(spark, d):
    names = read(spark, d, "part").select("p_name").distinct()
    return names.withColumn("distance", F.levenshtein("p_name", F.lit("red widgt"))).orderBy("distance", "p_name").limit(3)


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0) AS longest FROM documents")
def doc_numbers(spark, d):
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    return read(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("numbers"), F.coalesce(F.array_max(F.transform(found, F.char_length)), F.lit(0)).cast("long").alias("longest"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) + CAST(floor((length(text) - length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) / 4) AS BIGINT) AS tokens FROM documents""")
def doc_token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(html, '(?i)(at least|at most|more than|less than|>=|<=|>|<|大于|小于|不低于|超过)\s*[0-9]') THEN 'RULE' WHEN len(regexp_extract_all(html, '(?im)^\s*(step [0-9]+|[0-9]+[.)])\s')) >= 3 THEN 'PROCESS'
WHEN regexp_matches(html, '(?i)=.*(ratio|rate|share|%|率)') THEN 'METRIC' WHEN regexp_matches(html, '(?i)(is defined as|refers to|means|是指)') THEN 'CONCEPT' END AS kind FROM pages) GROUP BY 1""")
def structure_trigger(spark, d):
    return read(spark, d, "pages").groupBy(text.structure(F.col("html")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, length(html) AS n_chars FROM pages")
def doc_page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.char_length("html").cast("long").alias("n_chars"))


@query("""SELECT doc_id, 3 * CAST(regexp_matches(lower(text), '\\bthe\\b') AS BIGINT) + 4 * CAST(contains(lower(text), 'ering') AS BIGINT) - CAST(contains(lower(text), 'und') AS BIGINT) AS score FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b') OR contains(lower(text), 'ering')""")
def doc_term_score(spark, d):
    low = F.lower("text")
    the, ering, und = low.rlike(r"\bthe\b"), F.contains(low, F.lit("ering")), F.contains(low, F.lit("und"))
    return read(spark, d, "documents").filter(the | ering).select("doc_id", (3 * the.cast("long") + 4 * ering.cast("long") - und.cast("long")).alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), "event_type").filter("k >= 90")


L2 = "round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))), 4)"


# searches: every row whose identifier is divisible by 20, against all rows
@query(f"SELECT query_id, vec_id, rn, distance FROM (SELECT q.vec_id AS query_id, e.vec_id, {L2} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id) AS INT) AS rn FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rn <= 5")
def vec_topk_l2(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.top_k(v, v.filter("vec_id % 20 = 0"), 5, places=4)


@query(f"SELECT query_id, vec_id, rn, distance FROM (SELECT q.vec_id AS query_id, e.vec_id, {L2} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id) AS INT) AS rn FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label IN (1, 3)) WHERE rn <= 5")
def vec_filtered_topk(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.top_k(vectors.allowed(v, label=[1, 3]), v.filter("vec_id % 20 = 0"), 5, places=4)


@query(f"SELECT e.vec_id, round(1 / (1 + {L2}), 3) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3")
def vec_score(spark, d):
    v = read(spark, d, "embeddings")
    q = v.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(1 / (1 + F.round(vectors.l2(F.col("embedding"), F.col("q")), 4)), 3).alias("score"))
