"""Exact nearest neighbours of a few query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.sources.shared import saved

#: Up to so many query vectors are broadcast at once; more are dealt into blocks, and each block meets all rows in turn.
BROADCAST_QUERIES = 10_000
#: Rows of the corpus that a task takes; rows and queries that are multiplied at once; pairs whose distance is computed at once.
PART_ROWS, ROWS, QUERIES, PAIRS = 50_000, 4_096, 512, 500_000


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def score(distance: Column) -> Column:
    """1 / (1 + distance) to four places; 0 for what is no number."""
    bad = distance.isNull() | F.isnan(distance) | (distance == float("inf"))
    return F.when(bad, 0.0).otherwise(F.round(1 / (1 + F.greatest(distance, F.lit(0.0))), 4))


def top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """(query_id, key, distance, rn): the k nearest rows of each query, ties by key; with places, by the distance rounded to so many.

    A stated, small set of queries meets all rows: it's broadcast after a check of its size. Each task keeps the
    best k of what it has seen before rows are shuffled by query: a matrix product bounds all distances, and those that may
    be among the best are computed. Vectors that are null, hold a null or have another length are near nothing. A larger set is numbered and cut into blocks of at
    most BROADCAST_QUERIES; the rows of a block are written before the next one is broadcast.
    """
    q = _vectors(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("__q")), "__q")
    corpus = _vectors(corpus.select(key, vector), vector)
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() // PART_ROWS))
    corpus = corpus.repartition(parts, key)
    n = q.count()
    if n <= BROADCAST_QUERIES:
        return _nearest(corpus, q, k, key, vector, places)
    corpus = saved(corpus, "corpus")
    # numbers without a gap: row numbers within parts, and the parts' counts added up on the driver
    parts = saved(q.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "queries")
    first, begins = 0, []
    for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("low")).orderBy("__part").collect():
        begins.append((r["__part"], first - r["low"]))
        first += r["n"]
    shift = q.sparkSession.createDataFrame(begins, "__part int, __shift long")
    number = F.floor((F.col("__id") + F.col("__shift")) / BROADCAST_QUERIES)
    numbered = saved(parts.join(F.broadcast(shift), "__part").select("query_id", "__q", number.alias("__block")), "blocks")
    found = [saved(_nearest(corpus, numbered.filter(F.col("__block") == i).drop("__block"), k, key, vector, places), "nearest") for i in range(-(-n // BROADCAST_QUERIES))]
    return reduce(DataFrame.unionByName, found)


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def _nearest(corpus: DataFrame, q: DataFrame, k: int, key: str, vector: str, places: int | None) -> DataFrame:
    """A block of at most BROADCAST_QUERIES queries against all rows; each task yields its k nearest rows of each query."""
    spark, kinds = corpus.sparkSession, dict(corpus.dtypes)
    out = f"query_id {dict(q.dtypes)['query_id']}, {key} {kinds[key]}, distance double"
    asked = {}
    for r in q.collect():
        asked.setdefault(len(r["__q"]), []).append((r["query_id"], r["__q"]))
    block = spark.sparkContext.broadcast({n: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype="float64").reshape(len(rows), n)) for n, rows in asked.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: _Best(v, k, places) for n, (_, v) in block.value.items()}
        for batch in batches:
            sizes = batch[vector].map(len)
            for n in best.keys() & set(sizes):
                rows = batch[sizes == n]
                for at in range(0, len(rows), ROWS):
                    some = rows.iloc[at : at + ROWS]
                    best[n].add(some[key].to_numpy(), np.array(some[vector].tolist(), dtype="float64").reshape(len(some), n))
        for n, b in best.items():
            if b.ids is not None:
                yield pd.DataFrame({"query_id": block.value[n][0][b.query], key: b.ids, "distance": b.distance})

    pairs = corpus.mapInPandas(run, out)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("query_id", key, "distance", "rn")


class _Best:
    """The k nearest rows of each query of a block, by distance and key."""

    def __init__(self, queries: np.ndarray, k: int, places: int | None):
        self.q, self.k, self.places = queries, k, places
        self.square = (queries * queries).sum(1)
        self.query, self.ids, self.distance = np.empty(0, dtype="int64"), None, np.empty(0)
        self.most = np.full(len(queries), np.inf)  # the k-th distance so far

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        # of equal vectors only the k smallest keys can be among the k nearest
        order = np.lexsort((ids, *rows.T)) if rows.shape[1] else np.argsort(ids)
        ids, rows = ids[order], rows[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        begins = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        few = np.arange(len(rows)) - begins < self.k
        ids, rows = ids[few], rows[few]
        square = (rows * rows).sum(1)
        slack = 0.0 if self.places is None else 10.0**-self.places  # rounded distances tie
        found = []
        for at in range(0, len(self.q), QUERIES):
            q, sq = self.q[at : at + QUERIES], self.square[at : at + QUERIES]
            near = sq[:, None] + square[None, :] - 2 * (q @ rows.T)
            error = 1e-12 * (1 + rows.shape[1]) * (sq + square.max())
            most = self.most[at : at + QUERIES]
            if len(rows) >= self.k and not np.isfinite(most).all():
                kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                most = np.fmin(most, np.sqrt(np.maximum(kth + error, 0)))
            qi, ri = np.nonzero(~(near > ((most + slack) ** 2 + error)[:, None]))  # what is no number stays
            for i in range(0, len(qi), PAIRS):
                a, b = qi[i : i + PAIRS], ri[i : i + PAIRS]
                found.append(self._cut(a + at, ids[b], self._l2(q[a], rows[b])))
        self._merge(found)

    def _l2(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for j in range(a.shape[1]):  # in the order in which the sum is stated
            total += (a[:, j] - b[:, j]) ** 2
        d = np.sqrt(total)
        return d if self.places is None else np.floor(d * 10.0**self.places + 0.5) / 10.0**self.places

    def _cut(self, query: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> tuple:
        order = np.lexsort((ids, distance, query))
        query, ids, distance = query[order], ids[order], distance[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[keep], ids[keep], distance[keep]

    def _merge(self, found: list[tuple]) -> None:
        if self.ids is not None:
            found.append((self.query, self.ids, self.distance))
        if found:
            self.query, self.ids, self.distance = self._cut(*(np.concatenate(x) for x in zip(*found, strict=True)))
            first = np.searchsorted(self.query, np.arange(len(self.q)))
            full = np.bincount(self.query, minlength=len(self.q)) == self.k
            self.most[full] = self.distance[first[full] + self.k - 1]


def allowed(df: DataFrame, **values: list) -> DataFrame:
    """Rows whose columns have one of the given values: any within a column, all columns."""
    for c, v in values.items():
        df = df.filter(F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) if dict(df.dtypes)[c].startswith("array") else F.col(c).isin(v))
    return df
