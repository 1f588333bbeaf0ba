"""Exact deduplication over a log-structured merge index of digests.

* Memtable: what one scan task holds of a text's digest and identifier. It is flushed as sorted rows, dealt to RUNS
  runs; Parquet's Bloom filters stand in the files.
* A run is taken into the index: equal digests become one row with the identifier that stays and the number of rows.
  Before, the run is held against the filters of the tables that the index has: a filter is a table of blocks of
  32,768 bits, of which a digest has two in one block, sixteen bits for each digest. What passes is looked up in the
  tables themselves; where that is little, it is broadcast and they stay where they are.
* Compaction: FANOUT tables of a tier are merged by digest into one of the next tier, with a new filter.
* Hits (digests of several rows) are verified on their bytes: their texts are grouped by digest and whole text, with
  partial aggregation. Should two texts share a digest, they become two groups.

Only DataFrame expressions are used. Spark's partial aggregation collapses hot digests before a shuffle. Everything but
the runs and tables (some 50 bytes a row) is in proportion to the duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, fresh, saved, shared_path

RUNS, FANOUT = 2, 2
BLOCK_BITS = 32_768
#: Digests of a block on average.
BLOCK_ROWS = 2_048


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _with_digest(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("__id"), digest(text).alias("__digest"), text.alias("__text"))


def _write(rows: DataFrame, name: str, expected: int, *by: str) -> DataFrame:
    """A sorted table with Parquet's Bloom filters on the digest."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    bloom = {"parquet.bloom.filter.enabled#__digest": "true", "parquet.bloom.filter.expected.ndv#__digest": str(max(expected, 1))}
    rows.sortWithinPartitions(*by, "__digest").write.options(**bloom).partitionBy(*by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def flush(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_bytes, runs: int = RUNS
) -> DataFrame:
    """Rows (__digest, __id, __run): each scan task's memtable, sorted, in one of the runs. No shuffle."""
    rows = _with_digest(docs, id_col, text_col, digest).select("__digest", "__id", F.pmod(F.spark_partition_id(), F.lit(runs)).alias("__run"))
    return _write(rows, "runs", 200_000, "__run")


def _bits(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest and its two bits."""
    return F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(blocks)), [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK_BITS)) for k in (1, 2)]


def make_filter(table: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): a bitmap for each block that holds a digest of table."""
    block, bits = _bits(F.col("__digest"), blocks)
    rows = table.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))


def passing(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose digest a filter may hold: all that it holds, and few others."""
    block, bits = _bits(F.col("__digest"), blocks)
    name = fresh(rows, "block")
    found = rows.withColumn(name, block).join(broadcast_if_small(filter_.select(F.col("block").alias(name), F.col("bits").alias("__bits"))), name)
    for bit in bits:
        byte = F.conv(F.hex(F.substr("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found.filter(F.expr("1") == F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2)
    return found.select(*rows.columns)


@dataclass
class Table:
    """One sorted table of the index: rows (__digest, __keep, __n), and its filter."""

    rows: DataFrame
    tier: int
    count: int
    filter: DataFrame
    blocks: int


@dataclass
class Index:
    """A log-structured index of digests; keep is "min" or "max", the identifier that a digest keeps."""

    spark: SparkSession
    keep: str = "min"
    fanout: int = FANOUT
    tables: list[Table] = field(default_factory=list)

    def _best(self, column: str) -> Column:
        return (F.min if self.keep == "min" else F.max)(column)

    def _add(self, merged: DataFrame, tier: int) -> Table:
        rows = _write(merged, f"tier{tier}", 200_000)
        n = rows.count()
        blocks = n // BLOCK_ROWS + 1
        self.tables.append(Table(rows, tier, n, saved(make_filter(rows, blocks), "filter"), blocks))
        return self.tables[-1]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(__digest, __keep, __n) of the rows of digests (__digest) that the index holds, one for each table that does."""
        out = digests.sparkSession.createDataFrame([], self.tables[0].rows.schema) if self.tables else None
        for t in self.tables:
            maybe = broadcast_if_small(saved(passing(digests.select("__digest"), t.filter, t.blocks).distinct(), "maybe"))
            out = out.unionByName(t.rows.join(maybe, "__digest", "left_semi"))
        if out is None:
            raise ValueError("the index is empty")
        return out

    def absorb(self, run: DataFrame) -> DataFrame:
        """Take a run (__digest, __id) in; (__digest) of its rows that are not alone, in it or with what was there before."""
        seen = self.tables[:]
        memtable = run.groupBy("__digest").agg(self._best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        new = self._add(memtable, 0)
        hits = new.rows.filter("__n > 1").select("__digest")
        if seen:
            hits = hits.unionByName(Index(self.spark, self.keep, self.fanout, seen).lookup(new.rows).select("__digest"))
        hits = saved(hits.distinct(), "hits")
        self._compact()
        return hits

    def _compact(self) -> None:
        tier = 0
        while len(same := [t for t in self.tables if t.tier == tier]) >= self.fanout:
            rows = same[0].rows
            for t in same[1:]:
                rows = rows.unionByName(t.rows)
            self.tables = [t for t in self.tables if t.tier != tier]
            self._add(rows.groupBy("__digest").agg(self._best("__keep").alias("__keep"), F.sum("__n").alias("__n")), tier + 1)
            tier += 1


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256_bytes
) -> DataFrame:
    """One row for each row of docs: (id_col, keep_id, group_size, kept, digest).

    Rows with equal texts form a group, of which the smallest (keep="min") or largest (keep="max") identifier
    stays. Null texts count as empty ones; all empty texts are equal. A text is taken whole, however long. Where an
    identifier repeats, each of its rows is reported with its own text's group, and those with the same text alike. A
    null identifier stays only in a group without others. An empty table gives an empty result; other columns of docs
    are not looked at, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    best = F.min("__id") if keep == "min" else F.max("__id")
    runs = flush(docs, id_col, text_col, digest)
    index = Index(docs.sparkSession, keep)
    hits = None
    for r in range(RUNS):
        found = index.absorb(runs.filter(F.col("__run") == r).drop("__run"))
        hits = found if hits is None else hits.unionByName(found)
    hits = broadcast_if_small(saved(hits.distinct(), "hits"))  # few: whole texts stay where they are read
    members = _with_digest(docs, id_col, text_col, digest).join(hits, "__digest", "left_semi")
    classes = saved(members.groupBy("__digest", "__text").agg(best.alias("__keep"), F.count(F.lit(1)).alias("__n")), "verified")
    digests = saved(
        classes.groupBy("__digest").agg(F.count(F.lit(1)).alias("__texts"), F.max("__keep").alias("__keep"), F.max("__n").alias("__n")), "groups"
    )
    out = runs.join(broadcast_if_small(digests), "__digest", "left")
    if digests.filter("__texts > 1").isEmpty():
        rows = out.select("__id", "__digest", F.coalesce("__keep", "__id").alias("__keep"), F.coalesce("__n", F.lit(1)).alias("__n"))
    else:  # texts that share a digest: these rows are matched on their texts
        plain = out.filter("__texts is null or __texts = 1").select(
            "__id", "__digest", F.coalesce("__keep", "__id").alias("__keep"), F.coalesce("__n", F.lit(1)).alias("__n")
        )
        shared = digests.filter("__texts > 1").select("__digest")
        exact = members.join(shared, "__digest", "left_semi").join(classes, ["__digest", "__text"])
        rows = plain.unionByName(exact.select("__id", "__digest", "__keep", "__n"))
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__digest").alias("digest"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each text one row, that of the identifier that stays.

    Where rows repeat that identifier and the text, one of them stays, by a hash of all columns. Rows with a null
    identifier stay, whatever their text.
    """
    groups = saved(exact_groups(docs, id_col, text_col, keep).filter(F.col(id_col).isNotNull()).select(id_col, "kept", "digest"), "decided")
    names = [fresh(docs, n) for n in ("gone_id", "gone_digest")]
    digest = sha256_bytes(F.coalesce(docs[text_col], F.lit("")))

    def named(which: DataFrame) -> tuple[DataFrame, Column]:
        keys = broadcast_if_small(saved(which.toDF(*names), "keys"))
        return keys, (docs[id_col] == keys[names[0]]) & (digest == keys[names[1]])

    gone, same = named(groups.filter("not kept").select(id_col, "digest").distinct())
    out = docs.join(gone, same, "left_anti")
    again = groups.filter("kept").groupBy(id_col, "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col, "digest")
    again, same = named(again)
    if again.isEmpty():
        return out
    whole = F.struct(*[docs[c] for c in docs.columns])
    one = docs.join(again, same, "left_semi").groupBy(id_col, digest.alias(names[1])).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return out.join(again, same, "left_anti").unionByName(one)
