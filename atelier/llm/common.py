"""Helpers shared by the corpus operators: shared storage, column names, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Longs of the bit array by which most rows that a join would drop are left out before it.
MARKS = 1 << 17
#: Spark's setting by which the shuffle files of a query go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where the session names none, a
    local one is made for a local master; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            where = current.get()
        elif context.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="atelier-")
        else:
            raise ValueError("spark.checkpoint.dir names no shared folder")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where


@contextmanager
def _passing(df: DataFrame) -> Iterator[DataFrame]:
    """df as a query of its own, for one run: its shuffle files do not outlast it. Else they stay
    until the driver's collector finds that nothing refers to them, beside those of later queries."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        yield df.select("*")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with an eager, reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    with _passing(df) as once:
        return once.checkpoint()


def _store(spark: SparkSession, path: str):
    """The path as Hadoop names it, and the file system that holds it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of a wide table: write it as Parquet into the shared folder, read it
    again. Recomputation after a lost executor then starts from the files. They go when the
    application ends, or with discard()."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with _passing(df) as once:
        once.write.parquet(path)
    there, store = _store(spark, path)
    store.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from written() that no later result reads."""
    for table in tables:
        there, store = _store(table.sparkSession, table._written)
        store.delete(there, True)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts. For rows that an explode makes: Spark sizes them as
    those before it, many times too low, and would hold all of them in the driver to broadcast."""
    return df.hint("merge")


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name = f"_{name}"
    return name


def as_array(numbers: DataFrame, place: str, number: str) -> DataFrame:
    """One row, the array of the numbers by their places, which are all there from 0."""
    rows = numbers.groupBy(F.shiftright(place, 10).alias("row")).agg(F.sort_array(F.collect_list(F.struct(place, number))).alias("r"))
    ordered = F.sort_array(F.collect_list(F.struct("row", F.col("r")[number].alias("n"))))
    return cut(rows.agg(F.flatten(ordered["n"]).alias("numbers")))


def marked(hashes: DataFrame, asked: Column) -> Column:
    """False only where the hash asked is not among the hashes (h): a bit array of MARKS longs,
    whatever their number."""
    bits = F.expr("shiftleft(1L, cast(h & 63 as int))")
    cell = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(MARKS - 1))
    every = hashes.sparkSession.range(MARKS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("m"))
    held = hashes.select(cell.alias("cell"), bits.alias("m")).unionByName(every).groupBy("cell").agg(F.bit_or("m").alias("m"))
    array = as_array(held, "cell", "m")
    here = F.get(array.scalar(), F.shiftrightunsigned(asked, 6).bitwiseAND(F.lit(MARKS - 1)).cast("int"))
    return F.getbit(here, asked.bitwiseAND(F.lit(63)).cast("int")) == 1


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")
