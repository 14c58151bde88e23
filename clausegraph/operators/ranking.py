"""Ranks over whole tables without a single task: range partitions ranked by themselves, plus what stands before each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the cluster's shared checkpoint folder, so that two readers see the same rows."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/clausegraph-checkpoints")
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As :func:`fixed`, in Parquet: for tables of many narrow rows, which take a fraction of the space."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        fixed(spark.range(1))  # sets or demands the folder
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/ranked-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """Adds a 1-based rank within ``group`` by ``order``, which must decide all ties. A group of any size is spread over
    range partitions; the window over partition counts has one row per partition and group."""
    dealt = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    inner = stored(dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))))
    counts = inner.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *group, before.alias("_before"))
    return inner.join(offsets if group else F.broadcast(offsets), ["_part", *group]).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_part", "_row", "_before")


def top(df: DataFrame, group: list[str], order: list, count: int, name: str = "rank") -> DataFrame:
    """The first ``count`` rows of each group; the limit is pushed below the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= count)
