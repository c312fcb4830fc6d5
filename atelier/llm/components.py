"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step only groups by a node and joins the least neighbour back, so a hub is a partial
aggregate and a join whose skew Spark can split; no neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. Large: the larger neighbours of each node go to its least;
    small: the smaller ones and the node itself."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links
    least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = around.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.where(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node that
    can be reached. Self-links and repeated links do no harm."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = F.struct(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    seen = links.agg(mark).first()[0]
    while seen[0]:
        links = cut(_star(_star(links, True), False))
        now = links.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
