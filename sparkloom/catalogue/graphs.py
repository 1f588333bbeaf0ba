"""Graphs over suppliers that share an order, hierarchies, lineage and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.sources.tables import read

from . import Registry

query = Registry()

EDGES = """l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
g AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey),
w AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g), deg AS (SELECT a AS node, count(*) AS degree FROM w GROUP BY 1)"""


def _edges(spark, d):
    return graph.sharing(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def _groups(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("grp"))


@query(f"WITH {EDGES} SELECT node, degree FROM deg")
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {EDGES}, one AS (SELECT b AS node FROM w WHERE a = 1), two AS (SELECT DISTINCT w.b AS node FROM one JOIN w ON one.node = w.a) SELECT node, 1 AS depth FROM one UNION ALL SELECT node, 2 FROM two WHERE node <> 1 AND node NOT IN (SELECT node FROM one)")
def graph_hops_2(spark, d):
    return graph.hops(_edges(spark, d), spark.range(1, 2).withColumnRenamed("id", "node"), 2)


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT 2::BIGINT AS node, 0 AS depth UNION SELECT w.b, r.depth + 1 FROM r JOIN w ON r.node = w.a WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r WHERE node <> 2 GROUP BY 1")
def graph_hops_recursive(spark, d):
    return graph.hops(_edges(spark, d), spark.range(2, 3).withColumnRenamed("id", "node"), 4)


@query(f"""WITH {EDGES}, c AS (SELECT g.a, g.b, x.b AS c FROM g JOIN w x ON x.a = g.a JOIN w y ON y.a = g.b AND y.b = x.b)
SELECT g.a, g.b, count(c.c) AS common, round(coalesce(sum(1 / nullif(ln(degree), 0)), 0), 6) AS adamic_adar FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b LEFT JOIN deg ON deg.node = c.c GROUP BY 1, 2""")
def graph_adamic_adar(spark, d):
    return graph.common_neighbours(_edges(spark, d))


@query(f"WITH {EDGES} SELECT s_suppkey, coalesce(degree, 0) AS degree FROM supplier LEFT JOIN deg ON node = s_suppkey WHERE coalesce(degree, 0) <= 1")
def graph_gaps(spark, d):
    df = read(spark, d, "supplier").join(graph.degrees(_edges(spark, d)), F.col("node") == F.col("s_suppkey"), "left")
    return df.select("s_suppkey", F.coalesce("degree", F.lit(0)).alias("degree")).filter("degree <= 1")


@query(f"WITH {EDGES} SELECT w.a AS id, count(DISTINCT s_nationkey) AS groups, count(*) AS degree FROM w JOIN supplier ON w.b = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) >= 3 ORDER BY groups DESC, degree DESC, id LIMIT 20")
def graph_bridges(spark, d):
    return graph.bridges(_edges(spark, d), _groups(spark, d))


@query(f"""WITH {EDGES}, n AS (SELECT s_nationkey AS grp, count(*) AS nodes FROM supplier GROUP BY 1), i AS (SELECT x.s_nationkey AS grp, count(*) AS e FROM g JOIN supplier x ON g.a = x.s_suppkey JOIN supplier y ON g.b = y.s_suppkey WHERE x.s_nationkey = y.s_nationkey GROUP BY 1)
SELECT grp, nodes, coalesce(e, 0) AS edges, round(coalesce(e, 0) / nullif(nodes * (nodes - 1) / 2.0, 0), 3) AS cohesion FROM n LEFT JOIN i USING (grp)""")
def graph_cohesion(spark, d):
    return graph.cohesion(_edges(spark, d), _groups(spark, d))


@query(f"WITH {EDGES} SELECT a, b FROM g JOIN supplier x ON g.a = x.s_suppkey JOIN supplier y ON g.b = y.s_suppkey WHERE x.s_nationkey <> y.s_nationkey")
def graph_surprising(spark, d):
    return graph.surprising(_edges(spark, d), _groups(spark, d))


@query()
def graph_communities(spark, d):
    return graph.communities(_edges(spark, d))


@query("""SELECT 'PLACES' AS rel, count(DISTINCT (o_custkey, o_orderkey)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'CONTAINS', count(DISTINCT (o_orderkey, l_partkey)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'SUPPLIES', count(DISTINCT (l_suppkey, o_orderkey)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'ORPHAN', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def graph_build(spark, d):
    parts = graph.build(read(spark, d, "lineitem"), read(spark, d, "orders").filter("o_orderstatus <> 'P'"))
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).withColumn("rel", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS node, r_name AS path, 0 AS depth FROM region UNION ALL SELECT c.node, t.path || '/' || c.name, t.depth + 1 FROM t JOIN (SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent, n_name AS name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier) c ON c.parent = t.node)
SELECT node, path, depth FROM t""")
def rec_hierarchy(spark, d):
    child = lambda df, a, k, b, p, n: df.select(F.concat(F.lit(a), F.col(k)).alias("node"), F.concat(F.lit(b), F.col(p)).alias("parent"), F.col(n).alias("name"))
    c = child(read(spark, d, "nation"), "N", "n_nationkey", "R", "n_regionkey", "n_name").unionByName(child(read(spark, d, "supplier"), "S", "s_suppkey", "N", "s_nationkey", "s_name"))
    return spark.sql("""with recursive t(node, path, depth) as (select concat('R', r_regionkey), r_name, 0 from {roots}
        union all select c.node, concat(t.path, '/', c.name), t.depth + 1 from t join {children} c on c.parent = t.node) select node, path, depth from t""", roots=read(spark, d, "region"), children=c)  # fmt: skip


@query("SELECT * FROM (VALUES ('join', 'line', 'order'), ('join', 'line', 'part'), ('join', 'line', 'supplier'), ('join', 'order', 'customer'), ('join', 'customer', 'nation'), ('join', 'nation', 'region'), ('load', 'lineitem', 'line'), ('load', 'orders', 'order'), ('load', 'customer', 'customer'), ('load', 'supplier', 'supplier'), ('load', 'part', 'part'), ('load', 'nation', 'nation'), ('load', 'region', 'region')) v(kind, source, target)")
def lineage_edges(spark, d):
    from sparkloom.semantic.model import star

    c = star(spark, d)
    rows = [("join", j.left, j.right) for j in c.joins] + [("load", t.source, t.name) for t in c.tables.values()]
    return spark.createDataFrame(rows, "kind string, source string, target string").dropDuplicates()


@query("""WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), n AS (SELECT c_mktsegment, n_regionkey, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 7000 GROUP BY 1, 2)
SELECT s.c_mktsegment, r_name, coalesce(k, 0) AS k, CASE WHEN k IS NULL THEN 'MISSING' WHEN k < 10 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM s CROSS JOIN region LEFT JOIN n ON n.c_mktsegment = s.c_mktsegment AND n_regionkey = r_regionkey""")
def coverage_matrix(spark, d):
    customers = read(spark, d, "customer")
    # a grid of two small dimensions: their members' product is what is asked for
    grid = customers.select("c_mktsegment").distinct().crossJoin(F.broadcast(read(spark, d, "region")))
    n = customers.filter("c_acctbal > 7000").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("k"))
    status = F.when(F.col("k").isNull(), "MISSING").when(F.col("k") < 10, "PARTIAL").otherwise("COMPLETE")
    return grid.join(n, ["c_mktsegment", "r_regionkey"], "left").select("c_mktsegment", "r_name", F.coalesce("k", F.lit(0)).alias("k"), status.alias("status"))
