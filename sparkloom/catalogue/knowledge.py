"""Knowledge pages: blocks, chunks, references, conflicts, stages, coverage, relevance, gaps; suggested joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import graph, knowledge as K
from sparkloom.sources.tables import read

from . import Registry

query = Registry()

BLOCKS = """b AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, text FROM documents), k AS (SELECT doc_id, i - 1 AS i, (i - 1) // 12 AS page, string_split(text, chr(10))[i] AS block FROM b)"""


def _blocks(spark, d):
    rows = read(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "block"))
    return rows.select("doc_id", F.col("n").cast("long").alias("block_no"), F.floor(F.col("n") / 12).alias("page"), "block")


@query(f"""WITH RECURSIVE {BLOCKS}, f AS (SELECT doc_id, i, page, block, length(block) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM k),
w AS (SELECT doc_id, r, page, n, CAST(0 AS BIGINT) AS c, CASE WHEN n > 500 THEN 0 ELSE n END AS held, CASE WHEN n > 500 THEN 0 ELSE 1 END AS m, CASE WHEN n > 500 THEN CAST(ceil(n / 450.0) AS BIGINT) ELSE 0 END AS used FROM f WHERE r = 1
 UNION ALL SELECT f.doc_id, f.r, f.page, f.n,
 CASE WHEN f.n > 500 THEN w.c + w.used + CASE WHEN w.m > 0 THEN 1 ELSE 0 END WHEN w.m = 0 THEN w.c + w.used WHEN f.page <> w.page OR w.held + f.n + 1 > 500 THEN w.c + 1 ELSE w.c END,
 CASE WHEN f.n > 500 THEN 0 WHEN w.m = 0 OR f.page <> w.page OR w.held + f.n + 1 > 500 THEN f.n ELSE w.held + f.n + 1 END,
 CASE WHEN f.n > 500 THEN 0 WHEN w.m = 0 OR f.page <> w.page OR w.held + f.n + 1 > 500 THEN 1 ELSE w.m + 1 END,
 CASE WHEN f.n > 500 THEN CAST(ceil(f.n / 450.0) AS BIGINT) ELSE 0 END FROM w JOIN f ON f.doc_id = w.doc_id AND f.r = w.r + 1),
s AS (SELECT w.doc_id, w.c AS chunk_no, min(f.page) AS page, min(f.i) AS block_no, string_agg(f.block, chr(10) ORDER BY f.i) AS chunk FROM w JOIN f USING (doc_id, r) WHERE w.used = 0 GROUP BY 1, 2),
l AS (SELECT doc_id, c + u AS chunk_no, page, i AS block_no, substr(block, CAST(u * 450 + 1 AS BIGINT), 500) AS chunk FROM (SELECT w.doc_id, w.c, f.page, f.i, f.block, unnest(generate_series(0, w.used - 1)) AS u FROM w JOIN f USING (doc_id, r) WHERE w.used > 0))
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, page, block_no, sha256(chunk) AS chunk FROM (SELECT * FROM s UNION ALL SELECT * FROM l)""")
def doc_chunks(spark, d):
    return K.chunks(_blocks(spark, d), "doc_id").withColumn("chunk", F.sha2("chunk", 256))


MARKDOWN = r"""m AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '## end' || chr(10) || lang AS t FROM documents),
p AS (SELECT doc_id, trim(x) AS block, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_no, i FROM (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM m) WHERE trim(x) <> ''),
h AS (SELECT *, CASE WHEN paragraph_no = 1 THEN trim(substr(block, 3)) WHEN block LIKE '## end%' THEN 'end' END AS head, CASE WHEN block LIKE '## end%' THEN split_part(block, chr(10), 2) WHEN paragraph_no = 1 THEN '' ELSE block END AS body FROM p)"""


@query(rf"""WITH {MARKDOWN} SELECT doc_id, CAST(paragraph_no AS INT) AS paragraph_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY paragraph_no) AS section, sha256(body) AS body FROM h QUALIFY body <> ''""")
def doc_markdown_blocks(spark, d):
    docs = read(spark, d, "documents").filter("text is not null")
    text = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n## end\n"), "lang")
    return K.markdown_blocks(docs.select("doc_id", text.alias("t")), "doc_id", "t").withColumn("body", F.sha2("body", 256))


@query("""WITH t AS (SELECT o_orderkey AS id, 'Title ' || (o_custkey % 40) AS title, 'see title ' || (o_orderkey % 90) || ' and TITLE ' || (o_custkey % 9) || 'x' AS content FROM orders WHERE o_orderkey < 400)
SELECT a.id, b.id AS target FROM t a JOIN t b ON a.id <> b.id AND contains(lower(a.content), lower(b.title))""")
def page_references(spark, d):
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pages = read(spark, d, "orders").filter("o_orderkey < 400").select(k.alias("id"), text("Title ", c % 40).alias("title"), text("see title ", k % 90, " and TITLE ", c % 9, "x").alias("content"))
    return K.references(pages, "id", "title", "content")


RELATIONS = """r AS (SELECT l_orderkey AS upstream, l_partkey AS downstream, CASE l_returnflag WHEN 'R' THEN 'SUPERSEDES' ELSE 'CITES' END AS kind FROM lineitem), p AS (SELECT p_partkey AS page, CASE WHEN p_size > 40 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status, CASE WHEN p_size % 7 = 0 THEN TIMESTAMP '1999-01-01' END AS valid_to FROM part WHERE p_partkey % 11 <> 0)"""


@query(f"""WITH {RELATIONS} SELECT 'STALENESS' AS kind, upstream, downstream FROM (SELECT DISTINCT upstream, downstream FROM r JOIN p ON downstream = page WHERE kind <> 'SUPERSEDES' AND (status = 'EXPIRED' OR valid_to < TIMESTAMP '2000-01-01'))
UNION ALL SELECT 'GAP', upstream, downstream FROM (SELECT DISTINCT upstream, downstream FROM r WHERE downstream NOT IN (SELECT page FROM p))""")
def page_conflicts(spark, d):
    relations = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("upstream"), F.col("l_partkey").alias("downstream"), F.when(F.col("l_returnflag") == "R", "SUPERSEDES").otherwise("CITES").alias("kind"))
    size = F.col("p_size")
    pages = read(spark, d, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("page"), F.when(size > 40, "EXPIRED").otherwise("ACTIVE").alias("status"), F.when(size % 7 == 0, F.lit("1999-01-01").cast("timestamp")).alias("valid_to"))
    old = K.stale(relations, pages, F.lit("2000-01-01").cast("timestamp")).withColumn("kind", F.lit("STALENESS"))
    return old.unionByName(K.dangling(relations, pages).withColumn("kind", F.lit("GAP")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 'FULLY_STRUCTURED' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) OR o_orderpriority LIKE '1%' THEN 'SEMI_STRUCTURED' ELSE 'MARKDOWN' END AS stage FROM orders""")
def page_stages(spark, d):
    lines, orders = read(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")), read(spark, d, "orders")
    return K.stages(orders, "o_orderkey", lines.filter("l_quantity > 49"), [lines.filter("l_discount > 0.09"), orders.filter("o_orderpriority like '1%'")])


@query("""WITH p AS (SELECT c_mktsegment, n_regionkey AS region, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT s.x AS c_mktsegment, r_regionkey AS region FROM (SELECT DISTINCT c_mktsegment AS x FROM customer UNION SELECT 'NONE') s CROSS JOIN region),
a AS (SELECT c_mktsegment, region, count(DISTINCT c_custkey) AS pages, count(DISTINCT c_custkey) FILTER (WHERE c_acctbal > 8000) AS active, count(DISTINCT c_custkey) FILTER (WHERE c_acctbal < 0) AS expired FROM p GROUP BY 1, 2)
SELECT g.c_mktsegment, g.region, coalesce(pages, 0) AS pages, coalesce(active, 0) AS active, CASE WHEN coalesce(pages, 0) = 0 THEN 'MISSING' WHEN active = 0 AND expired > 0 THEN 'OUTDATED' WHEN active < pages THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM g LEFT JOIN a USING (c_mktsegment, region)""")
def page_coverage(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", F.col("n_regionkey").alias("region"), "c_custkey", "c_acctbal")
    segments = c.select("c_mktsegment").distinct().unionByName(spark.createDataFrame([("NONE",)], "c_mktsegment string"))
    grid = segments.crossJoin(F.broadcast(read(spark, d, "region").select(F.col("r_regionkey").alias("region"))))  # five regions: the grid is what is asked for
    return K.coverage(grid, ["c_mktsegment", "region"], c, "c_custkey", F.col("c_acctbal") > 8000, F.col("c_acctbal") < 0)


GRAPH = """w0 AS (SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey WHERE x.l_orderkey % 40 = 1),
w AS (SELECT a, b FROM w0 UNION ALL SELECT b, a FROM w0), dg AS (SELECT a AS n, count(*) AS k FROM w GROUP BY 1)"""


def _edges(spark, d):
    return graph.sharing(read(spark, d, "lineitem").filter("l_orderkey % 40 = 1"), "l_orderkey", "l_suppkey")


@query(f"""WITH {GRAPH}, q AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, x.s_nationkey = y.s_nationkey AS same, x.s_suppkey % 9 = y.s_suppkey % 9 AS src FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND (x.s_nationkey = y.s_nationkey OR x.s_suppkey % 9 = y.s_suppkey % 9)),
aa AS (SELECT q.a, q.b, round(sum(1 / ln(k)), 6) AS v FROM q JOIN w x ON x.a = q.a JOIN w y ON y.a = q.b AND y.b = x.b JOIN dg ON n = x.b GROUP BY 1, 2)
SELECT q.a, q.b, w0.a IS NOT NULL AS direct, src AS shared_source, coalesce(v, 0) AS adamic_adar, same AS same_dimension, round(3 * (w0.a IS NOT NULL)::INT + 4 * src::INT + 1.5 * coalesce(v, 0) + same::INT, 4) AS total FROM q LEFT JOIN w0 ON q.a = w0.a AND q.b = w0.b LEFT JOIN aa ON q.a = aa.a AND q.b = aa.b""")
def page_relevance(spark, d):
    s = read(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 9).alias("source"), F.col("s_nationkey").alias("dimension"))
    return K.relevance_in_groups(nodes, _edges(spark, d))


@query(f"""WITH {GRAPH}, n AS (SELECT s_suppkey, coalesce(k, 0) AS k, s_nationkey FROM supplier LEFT JOIN dg ON s_suppkey = n), i AS (SELECT x.s_nationkey AS grp, count(*) AS e FROM w0 JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey WHERE x.s_nationkey = y.s_nationkey GROUP BY 1),
z AS (SELECT s_nationkey AS grp, count(*) AS m FROM supplier GROUP BY 1)
SELECT 'ISOLATED' AS kind, CAST(s_suppkey AS VARCHAR) AS item FROM n WHERE k <= 1 UNION ALL SELECT 'UNCLASSIFIED', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 6 = 0
UNION ALL SELECT 'SPARSE', CAST(z.grp AS VARCHAR) FROM z LEFT JOIN i USING (grp) WHERE m >= 3 AND round(coalesce(e, 0) / (m * (m - 1) / 2.0), 3) < 0.15""")
def page_gaps(spark, d):
    s = read(spark, d, "supplier").withColumn("node", F.col("s_suppkey"))
    dims = s.select("node", F.when(F.col("s_suppkey") % 6 != 0, F.col("s_nationkey")).alias("dimension"))
    return K.gaps(s, _edges(spark, d), dims, s.select("node", F.col("s_nationkey").alias("grp")))


@query("""WITH x AS (SELECT DISTINCT l_returnflag AS kind, l_suppkey AS code FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY code) AS rn FROM x)
SELECT kind, string_agg(CAST(code AS VARCHAR), ',' ORDER BY CAST(code AS VARCHAR)) FILTER (WHERE rn <= 8) AS codes, count(*) AS n FROM r GROUP BY 1""")
def path_codes(spark, d):
    return K.path_summary(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("code")), "kind", "code")


@query("SELECT DISTINCT l_suppkey AS entity, o_orderkey AS document FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def graph_signed(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.when(F.col("o_orderpriority").startswith("1"), "CONTRACT").otherwise("OTHER").alias("type"))
    return K.signed(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_suppkey").alias("entity")), o)


@query("""SELECT o_custkey, max(o_orderkey) AS newest, max(o_orderkey) FILTER (WHERE rn = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)) WHERE back = 1 OR rn = 2 GROUP BY 1""")
def revision_lookup(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    history = read(spark, d, "orders").select("o_custkey", "o_orderkey", n.alias("revision"))
    newest = K.revisions(history, "o_custkey", "revision").select("o_custkey", F.col("o_orderkey").alias("last"))
    second = K.revisions(history, "o_custkey", "revision", 2).select("o_custkey", F.col("o_orderkey").alias("second"))
    both = newest.join(second, "o_custkey", "left")
    return both.select("o_custkey", F.greatest("last", "second").alias("newest"), "second")


def _columns(spark, d):
    """The model's columns without their prefixes, as a catalogue has them; the first of a table is its key."""
    rows = []
    for t in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        rows += [(t, t, c.partition("_")[2], i == 0 and t != "lineitem") for i, c in enumerate(read(spark, d, t).columns)]
    return spark.createDataFrame(rows, "class string, table string, column string, is_key boolean")


INFO = """i AS (SELECT table_name AS c, substr(column_name, instr(column_name, '_') + 1) AS n, ordinal_position = 1 AND table_name <> 'lineitem' AS k FROM information_schema.columns WHERE table_name IN ('lineitem', 'orders', 'customer', 'supplier', 'part', 'nation', 'region')),
j AS (SELECT DISTINCT x.c AS source, x.n AS source_column, y.c AS target, y.n AS target_column, CASE WHEN x.n = 'suppkey' THEN 'name_convention' ELSE 'shared_column' END AS how FROM i x JOIN i y ON x.n = y.n AND y.k AND x.c <> y.c AND (NOT x.k OR x.n = 'suppkey'))"""


@query(f"WITH {INFO} SELECT * FROM j")
def join_suggestions(spark, d):
    registry = spark.createDataFrame([("SUPPKEY", "SUPPLIER", "suppkey")], "column string, table string, key string")
    return K.shared_column_joins(_columns(spark, d), registry)


@query(f"WITH {INFO} SELECT c AS class, string_agg(n, ',' ORDER BY n) AS columns FROM i WHERE NOT k AND n LIKE '%key' AND c NOT IN (SELECT source FROM j WHERE target = 'supplier' OR source = 'nation' UNION SELECT target FROM j WHERE target = 'supplier' OR source = 'nation') GROUP BY 1")
def join_gap_classes(spark, d):
    columns = _columns(spark, d)
    joins = K.shared_column_joins(columns).filter("target = 'supplier' or source = 'nation'")
    return K.join_gaps(columns, joins, "key$")
