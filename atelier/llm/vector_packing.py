"""Vector best-fit packing of documents into training sequences.

Every piece is a vector of demands - tokens, one document, attention cost (length squared) -
and every sequence has a capacity for each. Longest pieces go first; each picks, among the
sequences that can take it under every constraint, the one with the smallest residual norm
(or the largest dot product), both weighted.

Pieces of one length have equal demands, so the choice is planned over the histogram of
lengths - at most `tokens` rows, whatever the corpus holds - as runs of equal sequences.
Spark then numbers the pieces of each length (salted, so that one common length is no single
task) and joins them with the plan.

Null and empty texts are one end token. A text that is longer than a sequence is cut into
full pieces; the first may be shorter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from atelier.llm import tree_bpe
from atelier.llm.common import fresh, written

#: Parts of a length that are numbered apart: at least SALTS, one for each PER_SALT pieces.
SALTS, PER_SALT = 64, 1 << 22
#: Rows of a plan or of its offsets up to which they are broadcast.
SMALL = 1 << 18


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, attention cost. The defaults of the last
    two never bind before the tokens do."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"rule is norm or dot, not {self.rule}")
        if min(self.tokens, self.documents, self.cost) < 1:
            raise ValueError("every capacity is at least 1")

    def worth(self, left: tuple, length: int) -> float:
        """The larger, the better a sequence with this residual suits the piece."""
        full = (self.tokens, self.documents, self.cost)
        need = (length, 1, length * length)
        shares = [(r / f, n / f, w) for r, n, f, w in zip(left, need, full, self.weights)]
        if self.rule == "dot":
            return sum(w * r * n for r, n, w in shares)
        return -sum(w * (r - n) ** 2 for r, n, w in shares)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of that length and
    those ranks go, one each, to consecutive sequences, at that offset."""
    runs, n_sequences = [], 0
    open_runs: dict[tuple, list] = defaultdict(list)  # residual -> [(first, end)]
    for length in sorted(histogram, reverse=True):
        if length > capacity.tokens or length * length > capacity.cost:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, left = 0, histogram[length]
        while left:
            fits = [r for r in open_runs if r[0] >= length and r[1] >= 1 and r[2] >= length * length]
            if fits:
                residual = max(fits, key=lambda r: (capacity.worth(r, length), r))
                first, end = open_runs[residual].pop()
                if not open_runs[residual]:
                    del open_runs[residual]
            else:
                residual, first = (capacity.tokens, capacity.documents, capacity.cost), n_sequences
                each = min(capacity.tokens // length, capacity.documents, capacity.cost // (length * length))
                end = n_sequences = n_sequences + -(-left // each)
            take = min(left, end - first)
            runs.append((length, rank, rank + take, first, capacity.tokens - residual[0]))
            if take < end - first:
                open_runs[residual].append((first + take, end))
            after = (residual[0] - length, residual[1] - 1, residual[2] - length * length)
            if after[0] > 0 and after[1] > 0 and after[2] > 0:
                open_runs[after].append((first, first + take))
            rank, left = rank + take, left - take
    return runs


def pieces(docs: DataFrame, tokens: int = 2048, end: int = 0, vocabulary: str = tree_bpe.VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    key = docs.schema["doc_id"].dataType
    kind = "long" if isinstance(key, IntegralType) else key.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        codec = tree_bpe.codec(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(codec.encode(text.as_py()), np.uint32(end)).astype("<u4")
                head = len(ids) % tokens
                starts = [*([0] if head else []), *range(head, len(ids), tokens)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            types = (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string")).mapInArrow(cut, schema)


def assign(cuts: DataFrame, capacity: Capacity, order: list[str], length: str = "length") -> DataFrame:
    """cuts with sequence_id and offset; cuts is read twice, so it should be stored. order
    names the columns that number pieces of one length."""
    spark = cuts.sparkSession
    salts = max(SALTS, -(-cuts.count() // PER_SALT))
    salt, rank, before, inside = (fresh(c, cuts) for c in ("salt", "rank", "before", "inside"))
    salted = cuts.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(length, salt).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    # at most `tokens` lengths by so many parts
    offsets = counts.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("n")).collect()}
    planned = plan(histogram, capacity)
    small = lambda df, n: F.broadcast(df) if n <= SMALL else df
    runs = spark.createDataFrame(planned, f"{length} long, _from long, _to long, _first long, offset long")
    own = Window.partitionBy(length, salt).orderBy(*order)
    ranked = salted.withColumn(inside, F.row_number().over(own) - 1).join(small(offsets, len(histogram) * salts), [length, salt])
    ranked = ranked.withColumn(rank, F.col(before) + F.col(inside))
    hit = (ranked[rank] >= runs["_from"]) & (ranked[rank] < runs["_to"]) & (ranked[length] == runs[length])
    out = ranked.join(small(runs, len(planned)), hit).withColumn("sequence_id", runs["_first"] + ranked[rank] - runs["_from"])
    return out.select(*[ranked[c] for c in cuts.columns], "sequence_id", runs["offset"])


def pack(docs: DataFrame, capacity: Capacity = Capacity(), end: int = 0, vocabulary: str = tree_bpe.VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and place: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Rows with one doc_id are told apart by their
    pieces' checksums; equal ones are interchangeable."""
    cuts = written(pieces(docs, capacity.tokens, end, vocabulary), "pieces")
    return assign(cuts, capacity, ["doc_id", "piece", "ids_crc32"])
