"""Streams over the submissions, run until the input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from atelier.operators.position import ensure_checkpoints
from atelier.operators.tables import recent_first
from atelier.streaming.state import state_store


def folder(spark: SparkSession) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def read_files(spark: SparkSession, path: str, schema, each: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first, `each` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)


def to_completion(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What the stream has written when its input is used up: all rows in append mode, the
    latest row of each key in update mode. Batches hold only what they changed; one that is
    run again after a failure overwrites itself."""
    spark, place = stream.sparkSession, folder(stream.sparkSession)
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/epoch={epoch}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    there = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(place)
    return (recent_first(found, keys, [F.desc("epoch")]) if mode == "update" else found).drop("epoch")
