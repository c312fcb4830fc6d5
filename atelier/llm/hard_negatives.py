"""Hard negatives by a secondary sort of packed pair scores.

A pair of an anchor and another row is one key of bytes: anchor, descending score, kind
(positives first), id. Compared as bytes, keys stand in that order, so
repartitionAndSortWithinPartitions deals them by anchor and sorts them, and one pass over a
partition does the rest: the first positives of an anchor open windows, and each negative that
falls into an open window is emitted until the window is full. A pass holds the few open
windows of one anchor, never its pairs.

Anchors are the stated query set. They are compared with all rows in blocks: a block of
anchors (at most about BLOCK bytes) goes to every task as a broadcast, and rows stay where they
are. Before the shuffle each task keeps what the answer can need of its rows, which loses
nothing: for an anchor its best positives, then, once an anchor's positives are known, the best
negatives of each window. A key that holds a third of all rows is so spread over all tasks.

Components become floor(256 * x); scores are exact integers. Components and scores beyond a
long count as its nearest end; shorter vectors are filled up with zeros. Rows with a null id,
label or vector, or with a null or non-finite component, take no part. Equal rows (id, label,
vector) are one. Rows of one id that differ are different candidates, but their anchor is one,
the row of the least label and vector; rows with the anchor's id are none of its candidates.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import written

#: Bytes of a block of anchors, and the anchors and bytes of rows that are multiplied at a time.
BLOCK, TILE, SLICE = 1 << 24, 512, 1 << 21
KEY = struct.Struct(">QQBQ")
_PACKED = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN, _ALL = 1 << 63, (1 << 64) - 1
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack(anchors: np.ndarray, scores: np.ndarray, negative: bool, ids: np.ndarray) -> np.ndarray:
    """Keys of pairs: their bytes sort by anchor, descending score, positives first, id."""
    up = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    out = np.empty(len(anchors), _PACKED)
    out["anchor"], out["score"], out["kind"], out["id"] = up(anchors), ~up(scores), negative, up(ids)
    return out


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    """anchor, score, is it a negative, id."""
    anchor, score, kind, i = KEY.unpack(key)
    return anchor - _SIGN, (_ALL - score) - _SIGN, bool(kind), i - _SIGN


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 * x) of every vector, filled up with zeros to the width."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False)), -(2.0**63), 2.0**63)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b, as longs."""
    if not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.vectorize(int, otypes=[object])(x)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each of n groups among the rows seen so far: larger scores
    first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.held = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, groups: slice, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """scores: a row for each of the groups, a column for each of the ascending ids."""
        k, n = self.scores.shape[1], scores.shape[1]
        bits = max(1, (n - 1).bit_length())
        if n > k and np.abs(scores, dtype=np.float64).max() < 2.0 ** (61 - bits):
            # score and place in one number, so that the best k are one partition
            none = np.iinfo(np.int64).min
            one = np.partition(np.where(fits, (scores << bits) | (n - 1 - np.arange(n)), none), n - k, axis=1)[:, n - k :]
            at, fit = n - 1 - (one & ((1 << bits) - 1)), one > none
        elif n > k:
            at = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~fits))[:, :k]
            fit = np.take_along_axis(fits, at, 1)
        else:
            at, fit = np.broadcast_to(np.arange(n), scores.shape), fits
        new = np.take_along_axis(scores, at, 1), ids[at], fit
        s, i, h = (np.concatenate(x, 1) for x in zip((self.scores[groups], self.ids[groups], self.held[groups]), new))
        first = np.lexsort((i, ~s, ~h))[:, :k]
        self.scores[groups], self.ids[groups], self.held[groups] = (np.take_along_axis(x, first, 1) for x in (s, i, h))


def limits(score: int) -> tuple[int, int]:
    """The least and the largest negative score that a positive's window takes."""
    return -(-50 * score // 100), 95 * score // 100


def mine(keys: Iterable[bytes], positives: int, negatives: int) -> Iterator[tuple]:
    """Rows of the result from keys in order."""
    now, n, windows = None, 0, []
    for key in keys:
        anchor, score, negative, i = unpack(key)
        if anchor != now:
            now, n, windows = anchor, 0, []
        if not negative:
            if n < positives:
                n += 1
                windows.append([i, score, *limits(score), 0])
            continue
        windows = [w for w in windows if w[4] < negatives and score >= w[2]]
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], i, w[1], score


def _sorted(keys: DataFrame) -> RDD:
    """The keys dealt by anchor, each partition in the order of its bytes."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return pairs.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]) % n).map(lambda pair: pair[0])


def _firsts(keys: Iterable[bytes], k: int) -> Iterator[tuple]:
    """The first k keys of each anchor."""
    now, n = None, 0
    for key in keys:
        now, n = (now, n + 1) if key[:8] == now else (key[:8], 1)
        if n <= k:
            yield (key,)


def _arrow(keys: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * KEY.size
    column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([column], names=["key"])


def _united(parts: list[np.ndarray]) -> np.ndarray:
    """The keys of all parts: one in several windows once, but as often as it is in any of
    them, where rows of one id have equal scores."""
    texts = [np.sort(p.view(f"S{KEY.size}")) for p in parts]
    keys = np.concatenate(texts)
    times = np.concatenate([np.arange(len(t)) - np.searchsorted(t, t) for t in texts])
    order = np.lexsort((times, np.unique(keys, return_inverse=True)[1])) if len(keys) else times
    keys, times = keys[order], times[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (times[1:] != times[:-1])) if len(keys) else times.astype(bool)
    return keys[new].view(_PACKED)


def _slices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """ids, labels and vectors of some rows at a time, by ascending id."""
    each = max(1, SLICE // 8 // max(width, 1))
    for batch in batches:
        for lo in range(0, batch.num_rows, each):
            ids, labels, vectors = batch.slice(lo, each).columns
            order = np.argsort(ids.to_numpy(), kind="stable")
            yield ids.to_numpy()[order], labels.to_numpy()[order], matrix(vectors, width)[order]


def hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 3, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    anchor: str = "id % 50 = 0", relabel: str = "if(id % 7 = 0, (label + 1) % 10, label)", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor says
    of id, label and v which rows are anchors, relabel gives the label that counts."""
    spark = rows.sparkSession
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    base = base.where(f"id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND coalesce({finite}, false)")
    base = base.select("id", F.expr(relabel).alias("label"), "v").where("label IS NOT NULL")
    base = written(base.dropDuplicates(["id", "label", "v"]), "vectors")
    width = base.agg(F.max(F.size("v"))).first()[0] or 1
    anchors = base.where(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    anchors = written(anchors, "anchors")
    blocks = -(-anchors.count() * width * 8 // block)
    found = []
    for b in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        held = spark.sparkContext.broadcast((some["id"].to_numpy(), some["label"].to_numpy(), matrix(some["v"], width)))

        def best_positives(batches, held=held):
            own, own_labels, x = held.value
            best = Best(len(own), positives)
            for ids, labels, v in _slices(batches, width):
                for lo in range(0, len(own), TILE):
                    t = slice(lo, lo + TILE)
                    best.add(t, products(x[t], v), ids, (own_labels[t, None] == labels) & (own[t, None] != ids))
            yield _arrow(pack(np.repeat(own, positives)[best.held.ravel()], best.scores[best.held], False, best.ids[best.held]))

        first = _sorted(base.mapInArrow(best_positives, "key binary")).mapPartitions(lambda keys: _firsts(keys, positives))
        opened = written(spark.createDataFrame(first, "key binary", verifySchema=False), "positives")
        # at most `positives` keys for each anchor of the block
        place = {i: k for k, i in enumerate(held.value[0].tolist())}
        bounds = np.tile(np.array([1, 0], np.int64), (len(place), positives, 1))
        filled = np.zeros(len(place), np.int64)
        for r in opened.collect():
            i, score, _, _ = unpack(bytes(r.key))
            bounds[place[i], filled[place[i]]] = limits(score)
            filled[place[i]] += 1
        windows = spark.sparkContext.broadcast(bounds)

        def best_negatives(batches, held=held, windows=windows):
            (own, own_labels, x), bounds = held.value, windows.value
            best = [Best(len(own), negatives) for _ in range(positives)]
            for ids, labels, v in _slices(batches, width):
                for lo in range(0, len(own), TILE):
                    t = slice(lo, lo + TILE)
                    scores, other = products(x[t], v), (own_labels[t, None] != labels) & (own[t, None] != ids)
                    for j, kept in enumerate(best):
                        low, high = bounds[t, j, :1], bounds[t, j, 1:]
                        kept.add(t, scores, ids, other & (scores >= low) & (scores <= high))
            keys = [pack(np.repeat(own, negatives)[k.held.ravel()], k.scores[k.held], True, k.ids[k.held]) for k in best]
            yield _arrow(_united(keys))

        pairs = opened.unionByName(base.mapInArrow(best_negatives, "key binary"))
        mined = _sorted(pairs).mapPartitions(lambda keys: mine(keys, positives, negatives))
        result = spark.createDataFrame(mined, _OUT, verifySchema=False)
        found.append(written(result, "negatives") if blocks > 1 else result)
    if not found:
        return spark.createDataFrame([], _OUT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE = """
WITH base AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM base a JOIN base r ON a.id <> r.id WHERE a.id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS i FROM pairs WHERE same) x WHERE i <= 5)
SELECT * FROM (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
    AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score) y WHERE rank <= 3"""
