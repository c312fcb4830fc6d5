"""Substring deduplication with content-defined chunks.

A gear rolling hash over the last 16 bytes sets chunk borders, so borders depend on nearby
content only and come back right after an insertion. A chunk whose digest is held by an
earlier place - a smaller document key, or an earlier chunk of the same document - is a
repeat. Neighbouring repeats form a span, and spans of at least `least` bytes are removed
from the text; the first holder of every chunk keeps it.

Null and empty texts have no chunks. Rows with equal key and text are one document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import fresh

#: Bits that must be zero at a border, and the smallest and largest chunk in bytes.
BITS, SMALLEST, LARGEST = 5, 16, 256
#: Bytes of repeated chunks in a row that make a span.
LEAST = 96


def _gear() -> np.ndarray:
    """256 well mixed 16-bit values, made by a rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.uint16)


GEAR = _gear()


def borders(data: bytes) -> list[int]:
    """Byte offsets of the chunk borders of a UTF-8 text, with 0 and its length; each is
    the start of a code point."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return []
    h = GEAR[b]
    for w in (1, 2, 4, 8):  # the hash of 2w bytes from two of w bytes
        h[w:] = h[w:] + (h[:-w] << np.uint16(w))
    starts = (b & 0xC0) != 0x80
    found = np.flatnonzero(h < (1 << (16 - BITS))) + 1
    out, last = [0], 0
    for at in [*found.tolist(), len(b)]:
        while at - last > LARGEST:
            forced = last + LARGEST
            while forced < len(b) and not starts[forced]:
                forced += 1
            if forced >= len(b):
                break
            out.append(forced)
            last = forced
        if at - last >= SMALLEST and at < len(b):
            while at < len(b) and not starts[at]:
                at += 1
            if at < len(b):
                out.append(at)
                last = at
    return [*out, len(b)]


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, sum (a checksum of the text), n, start (code points), size (bytes), chars,
    d1 and d2 (the digest) of every chunk of every text."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc", "sum", "n", "start", "size", "chars", "d1", "d2"]

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                which, sums, ns, starts, sizes, chars, digests = [], [], [], [], [], [], []
                for row, text in enumerate(part.column(1)):
                    data = (text.as_py() or "").encode()
                    at = borders(data)
                    if not at:
                        continue
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[at]
                    which.append(np.full(len(at) - 1, row))
                    sums.append(np.full(len(at) - 1, zlib.crc32(data)))
                    ns.append(np.arange(len(at) - 1))
                    starts.append(points[:-1])
                    sizes.append(np.diff(at))
                    chars.append(np.diff(points))
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at, at[1:])]
                if not which:
                    continue
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [pa.array(np.concatenate(c), t) for c, t in ((sums, pa.int64()), (ns, pa.int32()), (starts, pa.int32()), (sizes, pa.int32()), (chars, pa.int32()))]
                docs_of = part.column(0).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([docs_of, *columns, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=names)

    schema = f"doc {kind}, sum long, n int, start int, size int, chars int, d1 long, d2 long"
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(cut, schema)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key, sum (checksum of the text), start and stop (code points), n_bytes, n_chunks and
    first_KEY (who holds the span's first chunk first) of every repeated span."""
    all_chunks = chunks(docs, key, text)
    place = F.struct("doc", "sum", "n")
    held = all_chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    repeats = all_chunks.join(held.select("d1", "d2", "first"), ["d1", "d2"]).where(place != F.col("first"))
    repeats = repeats.select("doc", "sum", "n", "start", "size", "chars", F.col("first.doc").alias("of"))
    by_doc = Window.partitionBy("doc", "sum").orderBy("n")
    runs = repeats.withColumn("run", F.col("n") - F.dense_rank().over(by_doc)).distinct()
    found = runs.groupBy("doc", "sum", "run").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("chars")).alias("stop"),
        F.sum("size").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min_by("of", "n").alias(f"first_{key}"),
    )
    return found.where(F.col("n_bytes") >= least).drop("run").withColumnRenamed("doc", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs, its repeated spans cut out of the text; all rows stay."""
    doc, check, cuts = (fresh(c, docs) for c in ("doc", "sum", "spans"))
    gone = spans(docs, key, text, least).groupBy(F.col(key).alias(doc), F.col("sum").alias(check))
    gone = gone.agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, cuts in zip(texts, lists):
            t, at, kept = t.as_py(), 0, []
            for c in cuts.as_py() or []:
                kept.append(t[at : c["start"]])
                at = c["stop"]
            out.append(t if t is None else "".join([*kept, t[at:]]))
        return pa.array(out, pa.string())

    whole = F.col(text).cast("string")
    hit = F.col(key).eqNullSafe(F.col(doc)) & (F.crc32(whole.cast("binary")) == F.col(check))
    joined = docs.join(gone, hit, "left")
    new = F.when(F.col(cuts).isNull(), whole).otherwise(rest(whole, F.col(cuts)))
    return joined.select(*[(new if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
