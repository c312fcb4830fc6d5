"""Approximate nearest neighbours by an inverted multi-index.

The two halves of every unit vector are quantised on their own; a pair of centroids is a
cell, and each row is listed under its cell. A query walks the cells by the sum of its two
centroid distances, with a heap over the two sorted lists, until the cells hold the candidates
it needs and enough for k neighbours; those rows are reranked by the exact cosine of the
original vectors.

Centroids of a half grow with the fourth root of the rows, so cells with the square root. How
many candidates a query needs is learnt from the vectors: on a bounded sample, the walk is
followed until it holds a share REACH of the true neighbours; a quarter of the sample tells how
that number grows with the rows. Vectors in clusters need a few cells of any table; vectors
without a direction in common need most of it.

Only the centroids and that number are fitted on the sample; every row is indexed. Rows are
held once, in blocks of neighbouring cells; queries go to the blocks of the cells they visit.
Only where more than QUERIES of them ask one block are its rows copied. Each block hands on at
most k rows for a query. Vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part. Rows with one id and one vector are one.
Vectors are scaled by powers of two before anything is summed, so components of any size do.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import cut, written

#: Rows of the sample, most centroids of a half, rounds of their fit.
SAMPLE, MOST_CENTROIDS, ROUNDS = 8192, 1024, 12
#: Queries of the sample by which candidates are counted, and the share of neighbours they reach.
PROBES, REACH = 512, 0.96
#: Rows and queries of a block.
ROWS, QUERIES = 4096, 8192


def centroids(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's means of the rows of x; fewer than k where x has fewer rows."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Cells with rows, nearest first by first[i] + second[j], until they hold `least`."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        if n := counts[a[i], b[j]]:
            out.append(int(a[i]) * len(b) + int(b[j]))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(v: np.ndarray) -> np.ndarray:
    """Every row times the power of two that brings its largest component to 1/2 to 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Index:
    """The centroids of both halves, and how many rows each cell holds."""

    def __init__(self, x: np.ndarray, n_centroids: int):
        half = max(1, x.shape[1] // 2)
        self.parts = (slice(0, half), slice(half, None))
        self.halves = [centroids(x[:, p], n_centroids) for p in self.parts]
        self.shape = (len(self.halves[0]), len(self.halves[1]))

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Of unit vectors to the centroids of each half, squared, less a constant."""
        return [(c * c).sum(1) - 2 * x[:, p] @ c.T for c, p in zip(self.halves, self.parts)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return np.argmin(a, 1) * self.shape[1] + np.argmin(b, 1)


def many(n: int) -> int:
    """Centroids of a half for n rows."""
    return max(1, min(MOST_CENTROIDS, round(1.5 * n**0.25)))


def walked(x: np.ndarray, k: int) -> float:
    """How many of the rows x a query must walk through to hold a share REACH of its
    neighbours, among PROBES of them."""
    index = Index(x, many(len(x)))
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=index.shape[0] * index.shape[1]).reshape(index.shape)
    near = x[:PROBES] @ x.T
    np.fill_diagonal(near, -np.inf)
    best = np.argpartition(-near, min(k, len(x) - 2), axis=1)[:, :k]
    out = []
    for a, b, ids in zip(*index.distances(x[:PROBES]), best):
        order = walk(a, b, counts, np.inf)
        held = np.empty(counts.size)
        held[order] = np.cumsum(counts.ravel()[order])
        out += held[cells[ids]].tolist()
    return float(np.quantile(out, REACH))


def candidates(x: np.ndarray, n: int, k: int) -> float:
    """How many rows of n a query needs to meet, judged by the sample x."""
    if len(x) < 64:
        return float(n)
    whole, part = walked(x, k), walked(x[: len(x) // 4], k)
    growth = min(1.0, max(0.0, np.log(whole / part) / np.log(4)))
    return whole * max(1.0, n / len(x)) ** growth


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: neighbouring cells share one of about
    ROWS rows, a larger cell has several of its own."""
    flat = counts.ravel()
    large = flat > ROWS
    parts = np.where(large, -(-flat // ROWS), 1)
    base, free, shared, held = np.zeros(len(flat), np.int64), 0, -1, 0
    for c in range(len(flat)):
        if large[c]:
            base[c] = free
            free += int(parts[c])
            continue
        if shared < 0 or held + flat[c] > ROWS:
            shared, free, held = free, free + 1, 0
        base[c] = shared
        held += flat[c]
    return base, parts


def usable(vector: Column) -> Column:
    """Is the vector not null, not zero and all finite?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, share: float | None = None, n_centroids: int | None = None) -> DataFrame:
    """query_id, rank, key and score: for every query the k rows of largest cosine among
    those found, the query's own id left out; ties go to the smaller id. share: the share of
    all rows that a query meets, instead of the number learnt from a sample."""
    spark = rows.sparkSession
    clean = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base = written(clean(rows).dropDuplicates(["id", "v"]), "vectors")
    n = base.count()
    # an id may have several vectors: so many rows hold k ids besides the query's own
    least = (k + 1) * (base.groupBy("id").count().agg(F.max("count")).first()[0] or 0)
    lot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    chosen = base.where(lot < min(1.0, SAMPLE / max(n, 1)) * (1 << 30)).select("v").limit(2 * SAMPLE).collect() or base.select("v").limit(SAMPLE).collect()
    out = "query_id long, rank int, " + key + " long, score double"
    if not chosen:
        return spark.createDataFrame([], out)
    lengths = [len(r.v) for r in chosen]
    size = max(set(lengths), key=lengths.count)
    sample = unit(np.array([r.v for r in chosen if len(r.v) == size]))
    shared = spark.sparkContext.broadcast(Index(sample, n_centroids or many(n)))

    @F.arrow_udf("int")
    def cell_of(vectors: pa.Array) -> pa.Array:
        return pa.array(shared.value.cells(unit(_matrix(vectors))) if len(vectors) else [], pa.int32())

    cells = written(base.where(F.size("v") == size).withColumn("cell", cell_of("v")), "cells")
    # at most MOST_CENTROIDS squared numbers, whatever the rows are
    table = np.zeros(shared.value.shape, np.int64)
    for r in cells.groupBy("cell").count().collect():
        table.ravel()[r.cell] = r["count"]
    need = max(least, share * n if share is not None else candidates(sample, n, k))
    known = spark.sparkContext.broadcast((table, *blocks(table)))

    @F.arrow_udf("int")
    def block_of(found: pa.Array, lots: pa.Array) -> pa.Array:
        _, first, parts = known.value
        c = found.to_numpy(zero_copy_only=False)
        return pa.array(first[c] + lots.to_numpy(zero_copy_only=False) % parts[c], pa.int32())

    @F.arrow_udf("array<struct<block:int,cells:array<int>>>")
    def visits(vectors: pa.Array) -> pa.Array:
        table, first, parts = known.value
        out = []
        for a, b in zip(*shared.value.distances(unit(_matrix(vectors)))) if len(vectors) else ():
            to: dict[int, list[int]] = {}
            for c in walk(a, b, table, need):
                for block in range(int(first[c]), int(first[c] + parts[c])):
                    to.setdefault(block, []).append(c)
            out.append([{"block": block, "cells": c} for block, c in to.items()])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))])))

    asked = cut(clean(queries).where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")))
    right = asked.select("id", "v", F.explode(visits("v")).alias("x")).select("id", "v", "x.block", "x.cells")
    right = written(right, "visits")
    # a block asked by many queries has them dealt over several groups, and its rows copied
    groups = right.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))
    deal = lambda by: F.pmod(F.xxhash64(by, F.lit("group")), F.col("groups")).cast("int")
    left = cells.withColumn("block", block_of("cell", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(1 << 30)).cast("int")))
    left = left.join(groups, "block").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    right = right.join(groups, "block").withColumn("asked", deal("id")).drop("groups")

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, found = rows["id"].to_numpy(), []
        if len(ids) and len(asked):
            v, q, own = scaled(_matrix(rows["v"])), scaled(_matrix(asked["v"])), asked["id"].to_numpy()
            norms, lengths = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            here, local = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            most = k + len(ids) - len(np.unique(ids))  # that many rows hold k ids
            for lo in range(0, len(q), 256):
                near = q[lo : lo + 256] @ v.T / norms / lengths[lo : lo + 256, None]
                met = np.array([np.isin(here, c) for c in asked["cells"][lo : lo + 256].to_pylist()])
                near[~met[:, local] | (own[lo : lo + 256, None] == ids)] = -np.inf
                for i, s in enumerate(near):
                    floor = np.partition(s, -most)[-most] if len(s) > most else -np.inf
                    some = np.flatnonzero((s >= floor - 1e-9) & (s > -np.inf))
                    # summed alike for every pair: equal vectors get equal scores
                    exact = (v[some] * q[lo + i]).sum(1) / (norms[some] * lengths[lo + i])
                    # vectors of one id and direction stand next to each other and count once
                    order = np.lexsort((ids[some], -exact))
                    pairs = list(dict.fromkeys(zip(ids[some][order].tolist(), exact[order].tolist())))[:k]
                    found += [(int(own[lo + i]), a, b) for a, b in pairs]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["block", "asked"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
