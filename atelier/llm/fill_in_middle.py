"""Fill-in-the-middle: a text is cut in three at two unit borders and written in another order.

Units are words with the white space before them, and white space at the end of the text. A
text is seen as blocks of BLOCK code points; a Fenwick tree over them holds how many units end
in a block and how many code points it has. A cut after k units is found by a binary-lifting
descent to the block in which unit k ends, and only that block is read again for the place. So
a text of any length is never split into a list of its units.

Where the cuts lie, and the form, are drawn from the digest of seed and key, so a text is
treated alike in every run. plain: the text as it is, where it is empty or already holds a tag,
and for a share of the rest; psm and spm: three parts behind their tags, the middle last.

Null texts are empty. A null key counts as an empty one. Equal rows give equal results.
Columns of docs with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import fresh

#: Code points of a block.
BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class Fenwick:
    """Prefix sums over blocks, and the block in which a sum is reached."""

    def __init__(self, counts: np.ndarray):
        """counts: a row for each quantity, a column for each block."""
        size = counts.shape[1]
        sums = np.zeros((counts.shape[0], size + 1), np.int64)
        np.cumsum(counts, axis=1, out=sums[:, 1:])
        at = np.arange(size + 1)
        self.tree = sums - sums[:, at - (at & -at)]
        self.total = sums[:, -1]

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The first block up to whose end the first quantity reaches k, and the sums of all
        quantities before it."""
        size = self.tree.shape[1] - 1
        at, held, step = 0, np.zeros(len(self.tree), np.int64), 1 << size.bit_length()
        while step:
            if at + step <= size and held[0] + self.tree[0, at + step] < k:
                at += step
                held = held + self.tree[:, at]
            step >>= 1
        return at, held


def ends(text: str, block: int, size: int) -> np.ndarray:
    """Which code points of a block are the last of a unit."""
    lo = block * size
    points = np.frombuffer(text[lo : lo + size + 1].encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    last = np.append(~blank[:-1] & blank[1:], True) if lo + size >= len(text) else ~blank[:-1] & blank[1:]
    return last


class Units:
    """The units of a text, by blocks."""

    def __init__(self, text: str, size: int = BLOCK):
        self.text, self.size = text, size
        n = -(-len(text) // size)
        counts = [(int(np.count_nonzero(ends(text, b, size))), min(size, len(text) - b * size)) for b in range(n)]
        self.blocks = Fenwick(np.array(counts, np.int64).reshape(n, 2).T)
        self.n = int(self.blocks.total[0])

    def place(self, k: int) -> int:
        """Code points of the first k units."""
        if k <= 0:
            return 0
        block, (units, points) = self.blocks.descend(k)
        return int(points) + int(np.flatnonzero(ends(self.text, block, self.size))[k - int(units) - 1]) + 1


def cuts(text: str | None, first: int, second: int, size: int = BLOCK) -> tuple[int, int, int]:
    """Units of the text, and code points of its prefix and middle, for two drawn numbers."""
    units = Units(text or "", size)
    a, b = sorted((first % (units.n + 1), second % (units.n + 1)))
    prefix = units.place(a)
    return units.n, prefix, units.place(b) - prefix


def drawn(key: Column, which: int, seed: int) -> Column:
    """The number in one of the 8-digit groups of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output. rate: percent of the
    texts that are cut, spm: percent of those with the suffix first."""
    @F.arrow_udf("struct<n:bigint,prefix:bigint,middle:bigint>")
    def places(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        each = [cuts(t.as_py(), a, b) for t, a, b in zip(texts, first.to_pylist(), second.to_pylist())]
        columns = list(zip(*each)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix", "middle"])

    whole, found, form = (fresh(c, docs) for c in ("whole", "found", "form"))
    rows = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    name, t = F.col(f"`{key}`"), F.col(whole)
    plain = (t == "") | t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE) | (drawn(name, 3, seed) % 100 >= rate)
    rows = rows.withColumn(form, F.when(plain, "plain").when(drawn(name, 4, seed) % 100 < spm, "spm").otherwise("psm"))
    rows = rows.withColumn(found, places(t, drawn(name, 1, seed), drawn(name, 2, seed)))
    a, m = F.col(f"{found}.prefix").cast("int"), F.col(f"{found}.middle").cast("int")
    part = lambda tag, start, n: F.concat(F.lit(tag), F.substring(t, start, n))
    prefix, middle, suffix = part(PREFIX, F.lit(1), a), part(MIDDLE, a + 1, m), part(SUFFIX, a + m + 1, F.length(t))
    output = F.when(F.col(form) == "plain", t).when(F.col(form) == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    cut = F.col(form) != "plain"
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    return rows.select(
        *kept,
        F.col(f"{found}.n").alias("n"),
        F.col(form).alias("form"),
        F.when(cut, F.col(f"{found}.prefix")).alias("prefix_chars"),
        F.when(cut, F.col(f"{found}.middle")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. No part holds a tag and no tag can arise where a
    part meets one, so the tags tell the parts apart."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and rebuilt text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    done = transform(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM t),
f AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
