"""Dense positions in a total order, without an unpartitioned window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Name a checkpoint folder: the one of spark.checkpoint.dir. Where the session has none,
    a fresh local one for a local master; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    context.setCheckpointDir(where or tempfile.mkdtemp(prefix="atelier-"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new place in the checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{label}-{uuid.uuid4().hex}"


def global_position(df: DataFrame, order: list[Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """df with the 0-based position of each row in the order, which should be total, and, as
    `total`, the number of rows.

    Rows are range-partitioned and stored; the sizes of the partitions (one small row each)
    give the offsets, in a table that is joined, and a window inside each partition the rest.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    offsets, n = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r._part, n))
        n += r["count"]
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.join(F.broadcast(starts), "_part").withColumn(name, (inside + F.col("_start")).cast("long")).drop("_part", "_start")
    return out.withColumn(total, F.lit(n).cast("long")) if total else out


def position_in(df: DataFrame, groups: list[str], order: list[Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """As global_position, but within groups, which may be few and hold most rows: the global
    position in (groups, order) less that of the group's first row."""
    placed = global_position(df, [*map(F.asc, groups), *order], "_at")
    firsts = placed.groupBy(*groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    for g in groups:
        firsts = firsts.withColumnRenamed(g, f"_{g}")
    same = [placed[g].eqNullSafe(firsts[f"_{g}"]) for g in groups]
    out = placed.join(firsts, same).withColumn(name, F.col("_at") - F.col("_first"))
    out = out.withColumn(total, F.col("_n")) if total else out
    return out.drop("_at", "_first", "_n", *[f"_{g}" for g in groups])
