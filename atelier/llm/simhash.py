"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprints that differ in at most `distance` bits are cut into distance // 2 + 1 segments,
so that one segment of any linked pair differs in one bit at most. Each segment is indexed
once for every bit with that bit wiped; linked fingerprints meet under such keys, are paired
under the first of them only, and are verified by their full distance.

Rows with one fingerprint are one node, so exact copies are never paired. Null and empty
texts have fingerprint zero and link like any other. Rows that share a key are one document
with several fingerprints, which are linked through it. A row without a key links like any
other but names no component, unless all its rows lack one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from atelier.llm.common import cut, discard, fresh, marked, merged, written
from atelier.llm.components import components

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: One text in SAMPLED tells which shingles are common; at most COMMON of them are known.
SAMPLED, COMMON = 16, 1 << 17


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the text's word shingles, as unsigned."""
    tokens = (text or "").encode().lower().split()  # of bytes: A-Z; at \x20 and \x09-\x0D
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(tokens)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        spans = zip(first[k : k + BLOCK], last[k : k + BLOCK])
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of these unsigned hashes, as unsigned."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", size: int = 4, seed: int = 42) -> DataFrame:
    """docs with a long column that holds the fingerprint's 64 bits."""

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), size, seed) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64), pa.int64())

    return docs.withColumn(to, signed(F.col(text).cast("string")))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of 64 bits."""
    n = distance // 2 + 1
    at = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in prints (f) that differ in at
    most `distance` bits; each pair once."""
    masks = [(start, width, _signed(((1 << width) - 1) << start)) for start, width in segments(distance)]
    keys = [
        F.struct(F.lit(bit).alias("slot"), F.col("f").bitwiseAND(F.lit(_signed((mask & ~(1 << bit)) & (2**64 - 1)))).alias("rest"))
        for start, width, mask in masks
        for bit in range(start, start + width)
    ]
    # 64 rows from each: spread them first, over more tasks than small prints would get
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f")
    variants = spread.select("f", F.explode(F.array(*keys)).alias("k")).select("f", "k.slot", "k.rest")
    a, b = (variants.select(F.col("f").alias(n), "slot", "rest") for n in "ab")

    def own(slot: Column, bits: Column) -> Column:
        """Is this slot the first under which a pair with these differing bits meets?"""
        out = F.lit(False)
        for start, _, mask in reversed(masks):
            part = bits.bitwiseAND(F.lit(mask))
            here = (part == F.expr("shiftleft(1L, slot)")) | ((part == 0) & (slot == start))
            out = F.when(F.bit_count(part) <= 1, here).otherwise(out)
        return out

    met = merged(a).join(merged(b), ["slot", "rest"]).where("a < b")
    bits = F.col("a").bitwiseXOR(F.col("b"))
    return met.where((F.bit_count(bits) <= distance) & own(F.col("slot"), bits)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id - the smallest key that can be
    reached over linked fingerprints - of every row."""
    prints = cut(fingerprints(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", "f", size).select("k", "f"))
    nodes = cut(prints.groupBy("f").agg(F.min("k").alias("least")))
    # the fingerprints of one key are of one document
    several = prints.where("k IS NOT NULL").groupBy("k").agg(F.min("f").alias("a"), F.max("f").alias("last")).where("a < last")
    same = prints.join(several, "k").where("f <> a").select("a", F.col("f").alias("b"))
    joined = components(links(nodes.select("f"), distance).unionByName(same))
    placed = nodes.join(joined, nodes["f"] == joined["node"], "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    of = placed.join(placed.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("f", "component_id")
    return prints.join(of, "f").select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(text: str | None, size: int) -> set[bytes]:
    """The text's word shingles; a shorter text is one shingle of its own."""
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))}


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """A 64-bit hash of each of the text's shingles."""
    found = shingles(text, size)
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """key and component_id (the smallest key) of every row: texts whose sets of word shingles
    have a Jaccard similarity of at least `similarity` are linked."""
    names, _, grouped = _grouped(docs, key, text, size, similarity, distance)
    named = grouped.groupBy("c").agg(F.min("k").alias("component_id"))
    of = grouped.join(named, "c").select("m", "component_id")
    return names.join(of, "m").select(F.col("k").alias(key), "component_id")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def without_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """One row of docs of each group of similar texts: the one with the smallest key, then the
    smallest digest of the text; rows without a key come last, so one stays only where all of
    its group lack one. Of rows equal in key and text one stays. No other row goes."""
    names, nodes, grouped = _grouped(docs, key, text, size, similarity, distance)
    first = F.min(F.struct(F.col("k").isNull().alias("x"), "k", "m")).alias("first")
    name = lambda k, m: F.concat(m, F.coalesce(F.concat(F.lit(":"), k.cast("string")), F.lit("")))
    kept = cut(grouped.groupBy("c").agg(first).select(name(F.col("first.k"), F.col("first.m")).alias("id")))
    discard(names, nodes)
    id_, turn = fresh("id", docs), fresh("turn", docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(id_, name(F.col(f"`{key}`"), _digest(F.col(f"`{text}`"))))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    # a task passes on one row of each id, so that repeated rows meet in no single one
    one = rows.withColumn(turn, F.row_number().over(Window.partitionBy(id_).orderBy(F.xxhash64(*hashable)))).where(F.col(turn) == 1)
    return one.join(kept.withColumnRenamed("id", id_), id_, "left_semi").select(*columns)


def _grouped(docs: DataFrame, key: str, text: str, size: int, similarity: float, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """k (the key) and m (the text's digest) of every row; the stored texts; and m, c (the
    group) and k (the smallest key) of every distinct text.

    Fingerprints within `distance` bits, from their deletion variants, are the first
    candidates, and join most copies. But texts at 0.8 differ in about ten bits of a
    fingerprint, more than variants can bridge, so an exact prefix filter follows: in any
    fixed order of all shingles, two alike texts share one of their first
    n - ceil(similarity * n) + 1. The order is by frequency in
    a sample, so that common shingles come last, then by hash; the sample changes the number
    of candidates, not the result. Within a key every text is first compared with the key's
    least one of another component; then, as far as these links leave several components under
    one key, the texts of different components are compared with each other, unless their sizes
    and places under the key rule the similarity out. So a group of copies costs one comparison
    a text and key, and no pair is left open. Rows that share a key but not a text are texts of
    their own.
    """
    p, q = Fraction(str(similarity)).as_integer_ratio()

    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py(), size) for t in texts], pa.list_(pa.int64()))

    @F.arrow_udf("struct<s:long,n:int,f:array<long>>")
    def prefix(texts: pa.Array) -> pa.Array:
        common, often = known.value
        prints, sizes, firsts = [], [], []
        for t in texts:
            h = np.sort(shingle_hashes(t.as_py(), size))
            prints.append(majority(h.view(np.uint64)))
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                h = h[np.argsort(np.where(common[at] == h, often[at], 0), kind="stable")]
            sizes.append(len(h))
            firsts.append(h[: len(h) - -(-len(h) * p // q) + 1].copy())
        columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["s", "n", "f"])

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = shingles(x.as_py(), size), shingles(y.as_py(), size)
            out.append(len(x & y) * q >= len(x | y) * p)
        return pa.array(out, pa.bool_())

    def possible(i: str, n: str, j: str, m: str) -> Column:
        """Can texts of n and m shingles that first meet at places i and j be alike?"""
        return (F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (p + q)) >= (F.col(n) + F.col(m)) * p

    spark = docs.sparkSession
    whole = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    some = whole.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLED)) == 0).select("t").distinct()
    counts = some.select(F.explode(hashed("t")).alias("h")).groupBy("h").count().where("count > 2")
    common = sorted((r.h, r["count"]) for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    known = spark.sparkContext.broadcast((np.array([h for h, _ in common], np.int64), np.array([n for _, n in common], np.int64)))
    rows = written(whole.select("k", _digest(F.col("t")).alias("m"), prefix("t").alias("x")).select("k", "m", "x.s", "x.n", "x.f"), "prefixes")
    distinct = rows.groupBy("m").agg(*[F.min(c).alias(c) for c in ("k", "s", "n", "f")])
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")
    names = written(rows.select("k", "m"), "names")
    discard(rows)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose texts are alike."""
        pairs = cut(pairs.distinct())
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        asked = cut(nodes.select("node", "k", "m").join(asked, "node", "left_semi"))
        held = whole.join(asked.select("k").distinct(), whole["k"].eqNullSafe(asked["k"]), "left_semi").withColumn("m", _digest(F.col("t")))
        texts = asked.select("node", "m").join(held.select("m", "t"), "m").groupBy("node").agg(F.min("t").alias("t"))
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
        return both.where(alike("ta", "tb")).select("a", "b")

    prints = cut(nodes.groupBy("s").agg(F.min("node").alias("first")))
    copies = nodes.join(prints, "s").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(prints.select(F.col("s").alias("f")), distance)
    for n in "ab":
        near = near.join(prints.select(F.col("s").alias(n), F.col("first").alias(f"n{n}")), n)
    near = cut(verified(copies.unionByName(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))))
    groups = cut(components(near))

    def placed(table: DataFrame) -> DataFrame:
        return table.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    variants = placed(nodes.select("node", "n", "f")).select("node", "n", "c", F.posexplode("f").alias("i", "h"))
    # most shingles are in one text or one component: they go before rows are brought together
    shared = written(variants.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("h"), "shared")
    some = written(merged(variants.where(marked(shared, F.col("h")))).join(shared, "h", "left_semi"), "variants")
    leaders = some.groupBy("h").agg(F.min(F.struct("c", "node", "n", "i")).alias("l"))
    leaders = leaders.select("h", F.col("l.node").alias("least"), F.col("l.c").alias("lc"), F.col("l.n").alias("ln"), F.col("l.i").alias("li"))
    held = merged(some.drop("c")).join(leaders, "h")
    to_least = placed(held).where((F.col("c") != F.col("lc")) & possible("i", "n", "li", "ln")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    found = cut(near.unionByName(verified(to_least)))
    groups = cut(components(found))
    again = placed(held.select("h", "node", "n", "i"))
    open_keys = again.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("h")
    left = cut(again.join(open_keys, "h", "left_semi"))
    a, b = (left.select("h", *[F.col(c).alias(f"{c}{side}") for c in ("node", "n", "i", "c")]) for side in "ab")
    crossing = merged(a).join(merged(b), "h").where(F.col("ca") < F.col("cb")).where(possible("ia", "na", "ib", "nb"))
    crossing = crossing.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()
    groups = cut(components(found.unionByName(verified(crossing))))
    discard(shared, some)
    return names, nodes, placed(nodes.select("m", "k", "node")).select("m", "k", "c")
