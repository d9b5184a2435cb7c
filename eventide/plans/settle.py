"""Write a fitted lookup once so that later joins know its true size.

A lookup built by an aggregate has no size estimate when the join is planned, so the large side
is shuffled before AQE can see that the lookup was small. A written table has exact file sizes:
Catalyst broadcasts it when it is under ``spark.sql.autoBroadcastJoinThreshold`` and falls back
to a shuffled join when it is not. The files also cut the lineage, so a lost executor does not
cause the fit to run again.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session. Where none is set: a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, label: str = "lookup") -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_parts(df: DataFrame, part: str, label: str = "lookup") -> dict:
    """Materialise ``df`` once, in one folder per value of ``part``; gives value -> DataFrame without that column.

    Each piece is read from its own folder, so its size estimate is its own and not that of the whole.
    Values without rows are absent. The number of values is that of a declared list.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(part).parquet(path)
    rest = StructType([f for f in df.schema if f.name != part])
    whole = spark.read.schema(df.schema).parquet(path)
    values = [r[0] for r in whole.select(part).distinct().collect()]
    return {v: spark.read.schema(rest).parquet(f"{path}/{part}={v}") for v in values}
