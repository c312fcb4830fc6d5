"""Generic catalogue operators over any DataFrame: deduplication, anti joins, overlays,
merging, tallies. Keys and orders are Columns, so no Python runs on rows. Orders should end
in a unique column; rows with a null or empty key are never merged with each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def present(c: Column) -> Column:
    """The column with empty text as NULL."""
    return F.when(~blank(c), c)


def dedup_by(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key all stay. They are split off first, so
    that the commonest non-key makes no large group."""
    keyed = df.withColumn("_key", present(key))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    kept = keyed.where("_key IS NOT NULL").withColumn("_first", first).where("_first = 1").drop("_first")
    return kept.unionByName(keyed.where("_key IS NULL")).drop("_key")


def dedup_passes(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """dedup_by over one key after another."""
    return reduce(lambda d, key: dedup_by(d, key, order), keys, df)


def anti_existing(df: DataFrame, existing: DataFrame, keys: list[Callable[[DataFrame], Column]]) -> DataFrame:
    """Rows of df that share no key with a row of existing; missing keys match nothing."""
    for key in keys:
        seen = existing.select(present(key(existing)).alias("_seen")).where("_seen IS NOT NULL").distinct()
        marked = df.withColumn("_k", present(key(df)))
        df = marked.join(seen, F.col("_k") == F.col("_seen"), "left_anti").drop("_k")
    return df


def union_sources(sources: list[DataFrame | None], priority: str = "src_priority") -> DataFrame:
    """The sources one after another, each with its place as priority; absent ones are
    skipped and missing columns are NULL."""
    present_ = [s.withColumn(priority, F.lit(i)) for i, s in enumerate(sources) if s is not None]
    if not present_:
        raise ValueError("no source is present")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present_)


def tally(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """How often each value occurs, with its share in percent."""
    counts = df.groupBy(value.alias(name)).count().withColumnRenamed("count", "n")
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(name, "n", F.round(F.lit(100.0) * F.col("n") / F.col("_total"), 4).alias("share"))


def overlay(df: DataFrame, over: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """column from `over` where it has the key, else from df, else the default."""
    new = over.select(key, F.col(column).alias("_over"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_over", column, F.lit(default))).drop("_over")


def fill_missing(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with empty columns filled from source."""
    new = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(present(F.col(c)), present(F.col(f"_{c}"))) for c in columns}).drop(*[f"_{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new, and those of old whose key new has not."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def divided(chosen: DataFrame, facets: DataFrame, by: str, item: str) -> DataFrame:
    """Relational division: the items of facets (item, family, value) that have, of every
    family chosen (by, family, value), one of the values; for each value of by. A family that
    is not chosen is no limit."""
    chosen = chosen.select(by, "family", "value").distinct()
    asked = chosen.groupBy(by).agg(F.countDistinct("family").alias("_asked"))
    met = chosen.join(facets, ["family", "value"]).groupBy(by, item).agg(F.countDistinct("family").alias("_met"))
    return met.join(asked, by).where("_met = _asked").select(by, item)


def shards(positioned: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """A shard number by position modulo n."""
    return positioned.withColumn("shard", (F.col(position) % n).cast("int"))


def violations(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each failed rule: key, level, rule."""
    failed = [F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for level, name, bad in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*failed))).alias("v")).select(key, "v.level", "v.rule")


class GateError(ValueError):
    """A hard rule has failed."""


def gate(found: DataFrame) -> None:
    """Fail closed: raise where any violation is hard."""
    worst = found.where("level = 'hard'").groupBy("rule").count().orderBy(F.desc("count")).limit(5).collect()
    if worst:
        raise GateError(", ".join(f"{r.rule}: {r['count']}" for r in worst))


def recent_first(df: DataFrame, keys: list[str], time: list[Column]) -> DataFrame:
    """The latest row of each key."""
    last = Window.partitionBy(*keys).orderBy(*time)
    return df.withColumn("_i", F.row_number().over(last)).where("_i = 1").drop("_i")
