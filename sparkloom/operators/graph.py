"""Graphs as edge tables (a, b), undirected, each edge once with a < b."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.sources.shared import saved

#: Rows that a task takes where they are dealt in numbers that grow with the table.
ROWS = 500_000
#: Nodes and edge ends of a block; 64-bit words of a row that are compared at once, and of all rows; entries that cost as much to look up as a word to compare.
BLOCK_NODES, BLOCK_ENDS, COLUMNS, WORDS, LOOKUP = 100_000, 8_000_000, 128, 1 << 15, 30
#: Bits of a node's number; its block stands above them.
NUMBER_BITS = 40


def dealt(rows: int, df: DataFrame) -> int:
    """How many parts so many rows are dealt into, so that a task's share doesn't grow with them."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def sharing(rows: DataFrame, group: str, node: str) -> DataFrame:
    """Edges of nodes that share a group, from rows (group, node).

    Rows are dealt by group and pairs by both ends, in numbers of parts that grow with them, and pairs are made distinct
    behind that exchange: a task that held the distinct pairs of its groups would hold more of them the larger the table is.
    """
    x = rows.select(F.col(group).alias("__group"), F.col(node).alias("a")).filter("__group is not null and a is not null")
    parts = dealt(x.count(), x)
    x = x.repartition(parts, "__group").distinct()
    pairs = x.join(x.select("__group", F.col("a").alias("b")), "__group").filter("a < b").select("a", "b")
    return pairs.repartition(4 * parts, "a", "b").distinct()


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def hops(edges: DataFrame, start: DataFrame, most: int = 3) -> DataFrame:
    """(node, depth): what is reached from start (node) in 1 to 5 steps, with the smallest number of steps. A frontier of new nodes is joined in each step."""
    if not 1 <= most <= 5:
        raise ValueError("from 1 to 5 hops")
    links = saved(both_ways(edges), "links")
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, most + 1):
        near = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = saved(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def before(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Rows with the sum of size over all rows ahead of them in an order without ties: parts of a range are summed each, and begin where those ahead of them end."""
    rows = saved(df.repartitionByRange(dealt(df.count(), df), *order).withColumn("__part", F.spark_partition_id()), name)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__part").agg(F.sum(size).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__begin"))  # a row for each part
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), "__part").withColumn("before", F.col("__begin") + F.sum(size).over(inside) - F.col(size)).drop("__part", "__begin")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, common, adamic_adar) of each edge: the sum of 1 / ln(degree) over nodes next to both; only edges are scored, not all pairs.

    Nodes in the order of their keys are cut into blocks of about BLOCK_ENDS edge ends, of which a node counts as some
    more. Two blocks with an edge between them meet in one group, each node with the packed list of its neighbours, and the
    group's edges are scored there. A list is sent once for each block that it leads to, so with blocks as large as a task
    bears there are few copies. Paths of two edges, of which there are many more than edges, are never rows.
    """
    edges = saved(edges.select("a", "b"), "edges")
    deg = degrees(edges).withColumn("one", F.lit(1)).withColumn("load", F.col("degree") + BLOCK_ENDS // BLOCK_NODES)
    # numbers go by degree, so a list of numbers tells its degrees and only where each degree begins has to be known
    nodes = before(deg, ["degree", "node"], "one", "degrees").withColumnRenamed("before", "n")
    nodes = before(nodes, ["node"], "load", "numbers")
    nodes = saved(nodes.select("node", "degree", "n", (F.shiftleft(F.floor(F.col("before") / BLOCK_ENDS), NUMBER_BITS) + F.col("n")).alias("place")), "places")
    levels = sorted((r["n"], r["degree"]) for r in nodes.groupBy("degree").agg(F.min("n").alias("n")).collect())  # different degrees: fewer than twice the root of the edges
    begins, weights = np.array([x[0] for x in levels], dtype="int64"), np.array([1 / np.log(x[1]) if x[1] > 1 else 0.0 for x in levels])
    end = lambda key, place: nodes.select(F.col("node").alias(key), F.col("place").alias(place))
    ends = edges.join(end("a", "x"), "a").join(end("b", "y"), "b")
    links = ends.select(F.col("x").alias("place"), F.col("y").alias("to")).unionByName(ends.select(F.col("y").alias("place"), F.col("x").alias("to")))
    parts = dealt(2 * edges.count(), edges)
    lists = links.repartition(parts, "place").join(nodes.select("place", "node"), "place").select("place", "node", "to").sortWithinPartitions("place", "to")
    kind = edges.schema["a"].dataType.simpleString()
    sent = lists.mapInPandas(_sent, f"x long, y long, n long, node {kind}, begun binary, near binary")
    score = lambda rows: _scored(rows, begins, weights)
    return sent.groupBy("x", "y").applyInPandas(score, f"a {kind}, b {kind}, common long, adamic_adar double").withColumn("adamic_adar", F.round("adamic_adar", 6))


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in planes of bytes (how many comes first); the upper ones are mostly zeros, which exchanges compress."""
    steps = np.diff(numbers, prepend=0).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(data, "u1", offset=1)
    steps = np.zeros((len(planes) // width, 8), dtype="u1")
    steps[:, :width] = planes.reshape(width, -1).T
    return steps.view("<i8").ravel().cumsum()


def _sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (place, node, to) in order: each node, for each block that its edges lead to, with its whole list and with those edges that it begins, which are those to later places."""
    rest = None
    for rows in chain(batches, [None]):
        if rows is not None:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if not len(rows):
                continue
            whole = int(np.searchsorted(rows["place"].to_numpy(), rows["place"].iloc[-1]))  # the last node may go on in the next batch
            rows, rest = rows.iloc[:whole], rows.iloc[whole:]
        else:
            rows = rest
        if rows is None or not len(rows):
            continue
        place, to, node = rows["place"].to_numpy(), rows["to"].to_numpy(), rows["node"].to_numpy()
        out = []
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(place)], strict=True):
            own, ends = int(place[s]), to[s:e]
            block, numbers = own >> NUMBER_BITS, ends & ((1 << NUMBER_BITS) - 1)
            near, blocks = packed(np.sort(numbers)), ends >> NUMBER_BITS
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                other = int(blocks[i])
                out.append((min(block, other), max(block, other), own & ((1 << NUMBER_BITS) - 1), node[s], packed(numbers[max(i, np.searchsorted(ends, own)) : j]), near))
        yield pd.DataFrame(out, columns=["x", "y", "n", "node", "begun", "near"])


def _scored(rows: pd.DataFrame, begins: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """The edges that a group's nodes begin: neighbours in common, counted and weighed; begins and weights say from which number on nodes have which weight.

    Long lists become rows of bits, of which a word has columns of one degree only; of short ones each neighbour is looked up in the other list.
    """
    rows = rows.sort_values("n", ignore_index=True)
    begun = [unpacked(x) for x in rows["begun"]]
    i, j = np.repeat(np.arange(len(rows), dtype="int32"), [len(x) for x in begun]), np.searchsorted(rows["n"].to_numpy(), np.concatenate(begun)).astype("int32")
    del begun
    size = np.array([(len(x) - 1) // x[0] for x in rows["near"]])
    numbers, row = np.empty(size.sum(), dtype="int64"), np.repeat(np.arange(len(rows), dtype="int32"), size)
    for n, (s, x) in enumerate(zip(np.cumsum(size) - size, rows["near"], strict=True)):
        numbers[s : s + size[n]] = unpacked(x)
    keys = rows["node"].to_numpy()
    del rows
    first, second = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    first[i], second[j] = True, True
    columns = np.intersect1d(np.unique(numbers[first[row]]), np.unique(numbers[second[row]]), assume_unique=True)
    common, total = np.zeros(len(i), dtype="int64"), np.zeros(len(i))
    if len(columns):
        at = np.empty(len(numbers), dtype="int32")
        for s in range(0, len(numbers), 16 * WORDS):
            x = np.minimum(np.searchsorted(columns, numbers[s : s + 16 * WORDS]), len(columns) - 1)
            at[s : s + 16 * WORDS] = np.where(columns[x] == numbers[s : s + 16 * WORDS], x, -1)
        del numbers
        hit = at >= 0
        at, row = at[hit], row[hit]
        size = np.bincount(row, minlength=len(keys))
        level = np.searchsorted(begins, columns, side="right") - 1
        _, start, width = np.unique(level, return_index=True, return_counts=True)
        words = -(-width // 64)
        inside = np.arange(len(columns)) - np.repeat(start, width)
        word, bit = np.repeat(np.cumsum(words) - words, width) + inside // 64, np.left_shift(np.uint64(1), (inside % 64).astype("u8"))
        weight = np.repeat(weights[level[start]], words)
        least = np.minimum(size[i], size[j])
        _looked_up(np.flatnonzero((least > 0) & (least * LOOKUP < len(weight))), i, j, at, row, size, weights[level], common, total)
        _by_bits(np.flatnonzero(least * LOOKUP >= len(weight)), i, j, at, row, word, bit, weight, common, total)
    turned = keys[i] > keys[j]
    i[turned], j[turned] = j[turned], i[turned]
    return pd.DataFrame({"a": keys[i], "b": keys[j], "common": common, "adamic_adar": total})


def _looked_up(of, i, j, at, row, size, weight, common, total) -> None:
    """Each entry of the shorter list is looked up in the longer one; some lists at once."""
    if not len(of):
        return
    short, long = np.where(size[i[of]] <= size[j[of]], i[of], j[of]), np.where(size[i[of]] <= size[j[of]], j[of], i[of])
    begin, cells = np.cumsum(size) - size, row.astype("int64") * len(weight) + at
    steps = np.cumsum(size[short])
    cuts = np.unique(np.searchsorted(steps, np.arange(0, steps[-1], 16 * WORDS)))
    for s, e in zip(cuts, [*cuts[1:], len(of)], strict=True):
        n = size[short[s:e]]
        edge = np.repeat(np.arange(s, e), n)
        column = at[np.repeat(begin[short[s:e]], n) + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)]
        wanted = long[edge] * len(weight) + column
        hit = cells[np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)] == wanted
        common[of[s:e]] = np.bincount(edge[hit] - s, minlength=e - s)
        total[of[s:e]] = np.bincount(edge[hit] - s, weights=weight[column[hit]], minlength=e - s)


def _by_bits(of, i, j, at, row, word, bit, weight, common, total) -> None:
    """Rows of bits are compared, some words at once: the bits that two rows share are counted a word, and a word has one weight."""
    if not len(of):
        return
    used = np.zeros(int(max(i.max(), j.max())) + 1, dtype=bool)
    used[i[of]], used[j[of]] = True, True
    line = np.cumsum(used) - 1
    i, j = line[i[of]], line[j[of]]  # rows of the lists that are compared here
    keep = (row < len(used)) & used[np.minimum(row, len(used) - 1)]
    at, row = at[keep], line[row[keep]].astype("int32")
    width = max(1, min(COLUMNS, 128 * WORDS // len(line)))
    for c in range(0, len(weight), width):
        w = weight[c : c + width]
        low, high = np.searchsorted(word, [c, c + width])
        here = np.flatnonzero((at >= low) & (at < high))
        if not len(here):
            continue
        cell, value = row[here].astype("int64") * len(w) + (word[at[here]] - c), bit[at[here]]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))  # entries go by row and column
        bits = np.zeros((int(used.sum()), len(w)), dtype="u8")
        bits.ravel()[cell[starts]] = np.add.reduceat(value, starts)
        step = max(1, WORDS // len(w))
        for s in range(0, len(of), step):
            n = np.bitwise_count(bits[i[s : s + step]] & bits[j[s : s + step]])
            common[of[s : s + step]] += n.sum(axis=1, dtype="int64")
            total[of[s : s + step]] += np.einsum("ij,j->i", n, w)


def bridges(edges: DataFrame, groups: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """Nodes next to several groups (node, grp), by groups, then degree."""
    n = both_ways(edges).join(groups, F.col("b") == F.col("node")).groupBy(F.col("a").alias("id")).agg(F.count_distinct("grp").alias("groups"), F.count(F.lit(1)).alias("degree"))
    return n.filter(F.col("groups") >= least).orderBy(F.desc("groups"), F.desc("degree"), "id").limit(most)


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, nodes, edges, cohesion): inner edges over possible ones; groups of one node have none."""
    a, b = groups.select(F.col("node").alias("a"), F.col("grp").alias("ga")), groups.select(F.col("node").alias("b"), F.col("grp").alias("gb"))
    inner = edges.join(a, "a").join(b, "b").filter("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.count(F.lit(1)).alias("edges"))
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("nodes"))
    e = F.coalesce("edges", F.lit(0))
    return size.join(inner, "grp", "left").select("grp", "nodes", e.alias("edges"), F.round(e / F.nullif(F.col("nodes") * (F.col("nodes") - 1) / 2, F.lit(0.0)), 3).alias("cohesion"))


def surprising(edges: DataFrame, groups: DataFrame) -> DataFrame:
    a, b = groups.select(F.col("node").alias("a"), F.col("grp").alias("ga")), groups.select(F.col("node").alias("b"), F.col("grp").alias("gb"))
    return edges.join(a, "a").join(b, "b").filter("ga <> gb").select("a", "b")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community, size): label propagation; each node takes its neighbours' most frequent label, the smallest of equals. Single nodes go."""
    links = saved(both_ways(edges), "links")
    parts = dealt(links.count(), links)
    labels = saved(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        # a neighbour's labels are mostly different at first: they are counted behind the exchange, where a part is bounded
        cast = links.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").repartition(parts, "node", "label")
        votes = cast.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = saved(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")), "labels")
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return labels.join(size, "label").select("node", F.col("label").alias("community"), "size")


def neighbours(edges: DataFrame, node, most: int = 200) -> tuple[DataFrame, bool]:
    """The first edges of a node, and whether there are more."""
    rows = both_ways(edges).filter(F.col("a") == node).orderBy("b").limit(most + 1)
    return rows.limit(most), rows.count() > most


def build(lines: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """Nodes and relations of purchases: PLACES, CONTAINS and SUPPLIES are distinct edges; lines without an order are orphans."""
    known = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "PLACES": known.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).distinct(),
        "CONTAINS": known.select(F.col("o_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct(),
        "SUPPLIES": known.select(F.col("l_suppkey").alias("a"), F.col("o_orderkey").alias("b")).distinct(),
        "ORPHAN": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b")),
    }


def prune(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a release no longer has."""
    return old.join(new.select(*key), key, "left_anti")


def ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= most)
