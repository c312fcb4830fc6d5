"""BPE encoding and decoding by tree concatenation.

A long text is cut into leaves, the leaves are encoded on their own, and neighbours are
joined pairwise up a binary tree. Texts longer than a branch leave their row for that: each
branch is a row of its own, which any task may encode as a tree, and the branches of a text
then meet in one task, which only encodes windows. At each join a window around the cut is encoded again and
grown until a run of its ids agrees with the left half and another with the right half;
then the window replaces the ids between those runs. A sequence of BPE ids is the encoding
of its text when every two neighbours are, and each neighbour pair of the result is one of
the left half, of the window or of the right half, so the ids equal those of one pass.

Null and empty texts have no ids. Ids are kept packed: little-endian unsigned 32-bit
integers in a binary column, which JVM functions can measure, slice and digest.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import fresh, written

VOCABULARY = "byte_bpe_50k"
#: Longest text, in code points, that is encoded in one piece.
LEAF = 8192
#: Longest text, in code points, that one task encodes alone; a longer one is cut into such.
BRANCH = 1 << 16
#: First reach of the window to each side of a cut, in code points.
WINDOW = 64
#: Neighbouring ids that must agree at each side of a cut.
AGREE = 6


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """A byte-level BPE vocabulary, given by the name of a public tokenizer or as a path
    without its ending: NAME.json has the special tokens, NAME.tiktoken the ranks."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(_path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(_path(f"{vocabulary}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        self.special = frozenset(special)
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.bytes = np.empty(max([*ranks.values(), *special.values()]) + 1, dtype=object)
        self.bytes[:] = b""
        for piece, i in [*ranks.items(), *((name.encode(), i) for name, i in special.items())]:
            self.bytes[i] = piece
        self.length = np.array([len(p) for p in self.bytes], dtype=np.int64)

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a text in one pass."""
        return self.encoding.encode_to_numpy(text, allowed_special=self.special).astype("<u4", copy=False)

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, "<u4")
        cuts = [*range(0, len(text), leaf), len(text)]
        return self.joined(text, [(a, b, self.leaf(text[a:b])) for a, b in zip(cuts, cuts[1:])])

    def joined(self, text: str, level: list[tuple]) -> np.ndarray:
        """Ids of a whole text from the (a, b, ids of text[a:b]) of all its parts in order."""
        while len(level) > 1:
            odd = level[-1:] if len(level) % 2 else []
            level = [self.join(text, x, y) for x, y in zip(level[::2], level[1::2])] + odd
        return level[0][2]

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Join (a, m, ids of text[a:m]) and (m, b, ids of text[m:b])."""
        (a, m, x), (_, b, y) = left, right
        reach = WINDOW
        while m - reach > a or m + reach < b:
            lo, hi = max(a, m - reach), min(b, m + reach)
            window, before = self.leaf(text[lo:hi]), len(text[lo:m].encode())
            ends = np.cumsum(self.length[window]) - before
            head, tail = (0, 0), (len(y), len(window))
            if lo > a:
                keep = x[-before:]
                place = self.meet(keep, np.cumsum(self.length[keep]) - self.length[keep].sum(), window, ends)
                head = place and (len(x) - len(keep) + place[0], place[1])
            if hi < b:
                keep = y[: len(text[m:hi].encode())]
                tail = self.meet(keep, np.cumsum(self.length[keep]), window, ends)
            if head and tail and head[1] <= tail[1]:
                return a, b, np.concatenate([x[: head[0]], window[head[1] : tail[1]], y[tail[0] :]])
            reach *= 2
        return a, b, self.leaf(text[a:b])

    def meet(self, half: np.ndarray, half_ends: np.ndarray, window: np.ndarray, ends: np.ndarray) -> tuple | None:
        """Middle of the longest run of ids that half and window hold at the same bytes, as
        (place in half, place in window); None where no run has AGREE ids."""
        size = len(self.bytes)
        _, i, j = np.intersect1d(half_ends * size + half, ends * size + window, assume_unique=True, return_indices=True)
        breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
        starts, stops = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(i)]])
        longest = int(np.argmax(stops - starts))
        if stops[longest] - starts[longest] < AGREE:
            return None
        middle = (starts[longest] + stops[longest]) // 2
        return int(i[middle]), int(j[middle])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes[ids].tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of this process: a worker reads a vocabulary once."""
    return Codec(vocabulary)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, leaf: int = LEAF, branch: int = BRANCH) -> DataFrame:
    """df with a binary column of packed ids; an input column of that name is replaced. Rows
    with texts longer than a branch are stored first, since each gets a number."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        c = codec(vocabulary)
        return pa.array([c.encode(t.as_py(), leaf).tobytes() for t in texts], pa.binary())

    def cut(batches):
        for batch in batches:
            for row, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                for i in range(0, len(t), branch):
                    columns = [pa.array([row.as_py()], pa.int64()), pa.array([i], pa.int64()), pa.array([t[i : i + branch]], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "part"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((at, t, x) for b in batches for at, t, x in zip(*(b.column(n).to_pylist() for n in ("at", "part", "ids"))))
        whole = codec(vocabulary).joined("".join(t for _, t, _ in parts), [(at, at + len(t), np.frombuffer(x, "<u4")) for at, t, x in parts])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["row", "ids"])

    string = F.col(text).cast("string")
    long = F.coalesce(F.char_length(string) > branch, F.lit(False))
    short = df.where(~long).withColumn(ids, packed(string))
    row, whole = fresh("row", df), fresh("whole", df)
    held = written(df.where(long).withColumn(row, F.monotonically_increasing_id()), "long")
    if held.isEmpty():
        return short
    parts = held.select(F.col(row).alias("row"), string.alias("text")).mapInArrow(cut, "row long, at long, part string")
    parts = parts.repartition("row", "at").withColumn("ids", packed("part"))
    joined = parts.groupBy("row").applyInArrow(join, "row long, ids binary").select(F.col("row").alias(row), F.col("ids").alias(whole))
    return short.unionByName(held.join(joined, row).withColumn(ids, F.col(whole)).drop(row, whole))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text of a column of packed ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def unpacked(column: pa.Array) -> pa.Array:
        c = codec(vocabulary)
        return pa.array([c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in column], pa.string())

    return df.withColumn(text, unpacked(F.col(ids)))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of docs."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary=vocabulary).drop("text"), vocabulary=vocabulary)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
