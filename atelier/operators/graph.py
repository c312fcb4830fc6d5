"""Paths and clusters in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.operators.position import ensure_checkpoints


def ancestors(edges: DataFrame) -> DataFrame:
    """(s, o, depth): every node o that can be reached from s over edges (s, o), with the fewest
    steps. Each round joins the paths known with each other, so their length doubles; cycles
    end, because only new or shorter paths count. Meant for taxonomies, where a node has few
    ancestors: the result has a row for each."""
    ensure_checkpoints(edges.sparkSession)
    paths = edges.where("s <> o").select("s", "o", F.lit(1).alias("depth")).distinct().checkpoint()
    known = 0
    while True:
        mark = paths.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if tuple(mark) == known:
            return paths
        known = tuple(mark)
        second = paths.select(F.col("s").alias("o"), F.col("o").alias("t"), F.col("depth").alias("more"))
        joined = paths.join(second, "o").where("s <> t").select("s", F.col("t").alias("o"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = paths.unionByName(joined).groupBy("s", "o").agg(F.min("depth").alias("depth")).checkpoint()


def below(edges: DataFrame, root: str) -> DataFrame:
    """node and depth (the fewest steps) of every node from which root can be reached over edges
    (s, o), root itself left out. Nothing is kept of other pairs: nodes with one edge follow it by
    pointers that jump twice as far each round, a row each, to the next node with several edges, to
    root or to an end; only the nodes with several edges are then searched step by step."""
    ensure_checkpoints(edges.sparkSession)
    edges = edges.where((F.col("s") != F.col("o")) & (F.col("s") != root)).select("s", "o").distinct()
    counted = edges.groupBy("s").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")).checkpoint()
    hubs = counted.where("n > 1").select("s")
    single = counted.where("n = 1").select("s", "o", F.lit(1).alias("d")).checkpoint()
    # a pointer that has passed more nodes than there are goes round in a ring
    ends, open_, most, reach = None, single, single.count(), 1
    while True:
        stopped = open_.join(hubs.withColumnRenamed("s", "o"), "o", "left_semi").unionByName(open_.where(F.col("o") == root)).select("s", "o", "d").checkpoint()
        ends = stopped if ends is None else ends.unionByName(stopped)
        open_ = open_.join(stopped.select("s"), "s", "left_anti")
        if reach > most or open_.isEmpty():
            break
        # a step further where the next node has a pointer; its end, if that has one already
        known = open_.unionByName(ends).select(F.col("s").alias("o"), F.col("o").alias("to"), F.col("d").alias("more"))
        open_ = open_.join(known, "o").select("s", F.col("to").alias("o"), (F.col("d") + F.col("more")).alias("d")).checkpoint()
        reach *= 2
    # hubs' edges, and where those of one edge lead
    steps = edges.join(hubs, "s", "left_semi").join(ends.select(F.col("s").alias("o"), F.col("o").alias("to"), "d"), "o", "left")
    steps = steps.select("s", F.coalesce("to", "o").alias("o"), (F.coalesce("d", F.lit(0)) + 1).alias("d")).checkpoint()
    found = edges.sparkSession.createDataFrame([(root, 0)], "o string, depth int")
    near = found
    while True:
        nearer = steps.join(near, "o").groupBy("s").agg(F.min(F.col("d") + F.col("depth")).alias("depth")).select(F.col("s").alias("o"), "depth")
        near = nearer.join(found.select("o", F.col("depth").alias("old")), "o", "left").where("old IS NULL OR depth < old").select("o", "depth").checkpoint()
        if near.isEmpty():
            break
        found = found.unionByName(near).groupBy("o").agg(F.min("depth").alias("depth")).checkpoint()
    led = ends.join(found, "o").select(F.col("s").alias("node"), (F.col("d") + F.col("depth")).alias("depth"))
    return led.unionByName(found.where(F.col("o") != root).select(F.col("o").alias("node"), "depth"))


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and cluster (the least node that can be reached) of every node of nodes (node), over
    links (a, b) in both directions. A round takes the least label around each node, then the
    label of the label, so a chain's labels jump twice as far each time."""
    ensure_checkpoints(nodes.sparkSession)
    around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("label")).distinct().checkpoint()
    while True:
        near = around.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("new"))
        hooked = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("new", "label")).alias("new"))
        # what a node's own label has found serves all nodes of that label
        roots = hooked.groupBy("label").agg(F.min("new").alias("root"))
        jumped = hooked.join(roots, "label").select("node", "label", F.least("new", "root").alias("new"))
        of = jumped.select(F.col("node").alias("new"), F.col("new").alias("next"))
        moved = jumped.join(of, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")).checkpoint()
        if moved.where("new < label").isEmpty():
            return labels.select("node", F.col("label").alias("cluster"))
        labels = moved.select("node", F.col("new").alias("label"))
