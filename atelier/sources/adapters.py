"""Sources and sinks: module texts, quoted CSV, nested records, validated publishing."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def module_rows(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of texts of the form `NAME = [ {...}, ... ];`."""
    body = F.regexp_replace(F.regexp_replace(F.col(column), r"^\s*[\w.]+\s*=\s*", ""), r";\s*$", "")
    return texts.select(F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def read_module(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return module_rows(spark.read.text(path, wholetext=True), "value", schema)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of quoted CSV whose fields may hold commas, quotes and newlines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(*columns)


def bindings(texts: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Columns of query results that are flat maps of {name: {value}}."""
    found = F.from_json(F.col(column), "map<string,struct<value:string>>")
    return texts.select(*[F.try_element_at(found, F.lit(n))["value"].alias(n) for n in names])


def first_filled(*columns: Column) -> Column:
    """The first column that is neither NULL nor empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


class PublishError(ValueError):
    """What was staged is not fit to be published."""


def publish(df: DataFrame, folder: str, key: str, least: int = 1) -> DataFrame:
    """Write to a new place, check it, then append a pointer that names it. Places and
    pointers are only ever added, so readers see the last table or the new one, whole."""
    spark, place = df.sparkSession, f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(place)
    staged = spark.read.parquet(place)
    found = staged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("no_key")).first()
    if found.n < least or found.no_key:
        raise PublishError(f"{found.n} rows, {found.no_key} without {key}")
    pointer = spark.range(1).select(F.lit(place).alias("place"), F.lit(found.n).alias("n"), F.lit(time.time_ns()).alias("at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/pointers")
    return published(spark, folder)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The table that the last pointer names."""
    last = spark.read.parquet(f"{folder.rstrip('/')}/pointers").agg(F.max_by("place", "at").alias("place")).first()
    return spark.read.parquet(last.place)
