"""What the operators share: reading tables and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows of a batch that Python gets at once: whole texts are long, and a batch is held in memory.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Also keeps Python's batches small in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Where none is set, a local folder for a local master, as in tests; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _test_folder()
    return f"{base}/sparkloom/{name}-{uuid.uuid4().hex}"


#: Bytes up to which a written table is broadcast; an operator has at most a few such tables alive at once.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast table takes besides its values.
ROW_BYTES = 32


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its measured rows and values have at most BROADCAST_BYTES; beyond, the join shuffles."""
    wide = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in keys.schema.fields if f.dataType.typeName() != "array"]
    wide += [F.size(f.name) * 32 for f in keys.schema.fields if f.dataType.typeName() == "array"]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(ROW_BYTES))
    return F.broadcast(keys) if keys.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else keys


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose identifier is not in the one column of gone, a written table. Rows with a null identifier stay."""
    name = fresh(df, "gone_id")
    gone = broadcast_if_small(gone.toDF(name))
    return df.join(gone, df[id_col] == gone[name], "left_anti")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
