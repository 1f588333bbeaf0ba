"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Documents longer than a bin are cut; full pieces have a bin of their own. The other pieces are dealt by a hash into
shards of about shard_rows pieces, each packed in one task, so a task's work doesn't grow with the data and a hot
source is spread evenly. In a shard, pieces go from the largest to the smallest. Open bins stand in the order of
what they have left; from the first with enough room on, the search goes on until a bin holds neither the piece's
source nor its duplicate cluster: the tightest compatible one. Bins keep both as bitmaps.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin number of each item; items in order. No bin gets a source or a cluster twice, or more than capacity."""
    free: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        i = bisect_left(free, (size, -1))
        while i < len(free) and (source_bits[free[i][1]] & s or cluster_bits[free[i][1]] & c):
            i += 1
        if i < len(free):
            left, b = free.pop(i)
        else:
            left, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        insort(free, (left - size, b))
        out.append(b)
    return out


def _dealt(rows: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """(*columns of rows but __source and __cluster, bin_id) of a written table of pieces (__id, piece, start, size, __source, __cluster, ...)."""
    full = rows.filter(F.col("size") == capacity)
    rest = rows.filter(F.col("size") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))
    kept = [c for c in rows.columns if c not in ("__source", "__cluster")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", bin_id string"

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "__id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        codes = [pd.factorize(shard[c])[0].tolist() for c in ("__source", "__cluster")]
        bins = best_fit(shard["size"].tolist(), *codes, capacity)
        number = shard["__shard"].iloc[0]
        return shard[kept].assign(bin_id=[f"{number}-{b}" for b in bins])

    dealt = rest.withColumn("__shard", F.pmod(F.xxhash64("__id", "piece"), F.lit(shards)))
    packed = dealt.groupBy("__shard").applyInPandas(run, schema)
    name = F.concat_ws("-", F.lit("full"), F.col("__id").cast("string"), F.col("piece").cast("string"))
    return packed.unionByName(full.select(*kept, name.alias("bin_id")))


def pack(docs: DataFrame, capacity: int, size: Column, source: Column, cluster: Column, id_col: str = "doc_id", shard_rows: int = 1024) -> DataFrame:
    """One row for each piece: (id_col, piece int, start long, size long, bin_id string).

    A document of size n has ceil(n / capacity) pieces, at least one; start and size are in the unit of size. A null or
    negative size counts as 0; null sources and null clusters are values like any. Every row is packed, repeated
    identifiers too. Ties go by identifier, piece and then bin. An empty table gives an empty result; other columns
    are not looked at.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("__n")
    rows = docs.select(F.col(id_col).alias("__id"), n, F.xxhash64(source).alias("__source"), F.xxhash64(cluster).alias("__cluster"))
    last = F.greatest(F.ceil(F.col("__n") / capacity).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    rows = rows.select("__id", "piece", start.alias("start"), F.least(F.col("__n") - start, F.lit(capacity)).alias("size"), "__source", "__cluster")
    return _dealt(saved(rows, "pieces"), capacity, shard_rows).withColumnRenamed("__id", id_col)


def _byte(raw: Column, at: Column) -> Column:
    return F.hex(F.substr(raw, (at + 1).cast("int"), F.lit(1)))


def _character_start(raw: Column, at: Column) -> Column:
    """The largest start of a UTF-8 character at or before a place; at most three bytes back, in bytes that are not UTF-8 the place itself."""
    inner = lambda b: b.between("80", "BF")
    back = F.lit(0)
    for k in (3, 2, 1):
        back = F.when((at >= k) & inner(_byte(raw, at - (k - 1))), F.when(inner(_byte(raw, at - k)), back).otherwise(F.lit(k))).otherwise(F.lit(0))
    return at - back


def pack_texts(
    docs: DataFrame, capacity: int, source: Column, cluster: Column, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 1024, with_text: bool = False
) -> DataFrame:
    """pack for texts, by bytes of UTF-8: (id_col, piece, start, size, bin_id) and, if asked for, the piece's text.

    A text of more than capacity bytes is cut at the last character that starts within each capacity - 3 bytes, so that no
    character is parted, no piece is longer than capacity, and all pieces are cut alike however long the text. Null
    texts are empty and have one piece of size 0. For the rest see pack.
    """
    if capacity < 4:
        raise ValueError("capacity must be 4 or more")
    step = capacity - 3
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("__id"), raw.alias("__raw"), F.xxhash64(source).alias("__source"), F.xxhash64(cluster).alias("__cluster"))
    n = F.octet_length("__raw").cast("long")
    last = F.when(n <= capacity, 0).otherwise(F.ceil(n / step).cast("int") - 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"), last.alias("__last"))
    begin = _character_start(F.col("__raw"), F.col("piece").cast("long") * step)
    end = F.when(F.col("piece") == F.col("__last"), n).otherwise(_character_start(F.col("__raw"), (F.col("piece") + 1).cast("long") * step))
    text = [F.substr("__raw", (begin + 1).cast("int"), (end - begin).cast("int")).cast("string").alias("text")] if with_text else []
    rows = rows.select("__id", "piece", begin.alias("start"), (end - begin).alias("size"), "__source", "__cluster", *text)
    return _dealt(saved(rows, "pieces"), capacity, shard_rows).withColumnRenamed("__id", id_col)


def bins(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(bin_id, n_pieces, size, pieces array<struct<id, piece, text>>) of pack_texts with texts: what a bin holds, at most its capacity."""
    inside = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), "piece", "text")))
    return packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("size"), inside.alias("pieces"))
