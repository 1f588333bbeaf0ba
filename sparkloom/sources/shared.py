"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


@lru_cache
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _test_folder()
    return f"{base}/sparkloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of iterative work; survives the loss of executors."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


#: Bytes up to which a written table is broadcast.
BROADCAST_BYTES = 32 << 20


def catalogue_side(keys: DataFrame, name: str) -> DataFrame:
    """The side of a join with a catalogue (terms, phrases, titles), written and measured: broadcast up to BROADCAST_BYTES, else merged.

    The other side is exploded and many times the size that Spark estimates, so it must not be the one that is broadcast.
    """
    keys = saved(keys, name)
    wide = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.size(f.name) * 32 if f.dataType.typeName() == "array" else F.lit(8) for f in keys.schema.fields]
    size = keys.agg(F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(32))), F.lit(0))).first()[0]
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys.hint("merge")
