"""Language identification with blended-spectrum string kernels.

Two texts are as alike as the character n-grams (n = 1, 2, 3) that both hold: for each n the
presence kernel |A & B| / sqrt(|A| |B|), blended with fixed weights. Landmark texts give a
Nystrom map of that kernel, and a ridge regression on it separates each language from the
rest. Texts are scored in batches: presence rows times landmarks times coefficients, where
the last two factors are multiplied once for all.

N-grams are hashed to the columns of SPECTRA, so the kernel is approximate: scripts of many
characters share columns. The classifier is fitted on a bounded sample: at most PER_LABEL texts
of each label, chosen by a hash of key and text, MOST_SAMPLE in all, of the MOST_LABELS most
frequent labels (other labels are never predicted); repeated rows count once in it. The sample's
presence rows are bits, of 5 KB each on the driver, and are unpacked in blocks. Whole texts are read, in the fit and in predictions.
A text that is null or has no letter is `und` with score 0, as is every text where nothing
is labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import fresh

#: (n, log2 of the hashed width, weight) of each spectrum.
SPECTRA = ((1, 10, 0.2), (2, 13, 0.3), (3, 15, 0.5))
WIDTH = sum(1 << bits for _, bits, _ in SPECTRA)
UNKNOWN = "und"
RESULTS = ("held_out", "lang_pred", "score")
#: Bounds of the fit: texts of a label, texts in all, labels, landmarks in all.
PER_LABEL, MOST_SAMPLE, MOST_LABELS, MOST_LANDMARKS = 400, 8192, 256, 512
RIDGE = 1e-3
BATCH = 64


def presence(text: str, row: np.ndarray) -> None:
    """Mark the text's n-grams in a zero row, scaled so that row products are kernels."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    at = 0
    for n, bits, weight in SPECTRA:
        part = row[at : at + (1 << bits)]
        at += 1 << bits
        grams = points[: len(points) - n + 1] if len(points) >= n else points[:0]
        for k in range(1, n):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k]
        part[(grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)] = 1
        if held := np.count_nonzero(part):
            part *= np.float32(np.sqrt(weight / held))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Presence rows, scaled so that row products are kernels, from their bits."""
    out = np.unpackbits(bits, axis=1, count=WIDTH).astype(np.float32)
    at = 0
    for _, wide, weight in SPECTRA:
        part = out[:, at : at + (1 << wide)]
        at += 1 << wide
        part *= np.sqrt(weight / np.maximum(np.count_nonzero(part, axis=1), 1)).astype(np.float32)[:, None]
    return out


def fit(rows: np.ndarray, labels: list[str], ridge: float = RIDGE, landmarks: int = MOST_LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, coefficients of the presence columns, offsets) from presence bits."""
    names = sorted(set(labels))
    index = np.array([names.index(x) for x in labels])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(index == k)[:each] for k in range(len(names))])
    z = unpacked(rows[chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([(unpacked(rows[i : i + BATCH]) @ z.T).astype(np.float64) @ root for i in range(0, len(rows), BATCH)])
    y = np.where(index[:, None] == np.arange(len(names)), 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = (1.0 / np.bincount(index))[index][:, None]
    weight /= weight.sum()
    mean, offset = (weight * phi).sum(0), (weight * y).sum(0)
    centred = phi - mean
    gram = (centred * weight).T @ centred
    w = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)) + 1e-12 * np.eye(len(gram)), (centred * weight).T @ (y - offset))
    return names, z.T @ (root @ w).astype(np.float32), (offset - mean @ w).astype(np.float32)


def sample(docs: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, list[str]]:
    """Presence bits and labels of a bounded sample of the labelled rows of docs."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where("l is not null")
    often = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LABELS)
    counts = {r.l: r["count"] for r in often.collect()}
    if not counts:
        return np.zeros((0, WIDTH // 8), np.uint8), []
    each = min(PER_LABEL, MOST_SAMPLE // len(counts))
    # a first lot leaves about twice as many as are wanted, and the least hashes of a label stay
    shares = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 2 * (each + 20) / n))])
    lot = F.pmod(F.col("h"), F.lit(1_000_000)) / 1e6
    labelled = labelled.where(F.col("l").isin(list(counts)) & F.col("t").isNotNull()).withColumn("h", F.xxhash64("k", "t", F.lit("sample")))
    drawn = labelled.where(lot < shares[F.col("l")]).dropDuplicates(["l", "h"])
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= each).select("k", "l", "t")

    def rows(batches):
        for batch in batches:
            bits = []
            for t in batch.column(2):
                row = np.zeros(WIDTH, np.float32)
                if has_letter(t.as_py()):
                    presence(t.as_py(), row)
                bits.append(np.packbits(row > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["k", "l", "bits"])

    kind = chosen.schema["k"].dataType.simpleString()
    found = chosen.mapInArrow(rows, f"k {kind}, l string, bits binary").collect()
    found = sorted((r for r in found if any(r.bits)), key=lambda r: (r.l, r.bits))
    found = [found[i] for i in np.random.default_rng(0).permutation(len(found))]
    out = np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(-1, WIDTH // 8)
    return out, [r.l for r in found]


def predict(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def scored(texts: pa.Array) -> pa.Array:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if shared.value is not None:
            languages, weights, offset = shared.value
            block = np.empty((BATCH, WIDTH), np.float32)
            for a in range(0, len(texts), BATCH):
                block[:] = 0
                some = [(i, t) for i, t in ((i, texts[i].as_py()) for i in range(a, min(a + BATCH, len(texts)))) if has_letter(t)]
                for row, (_, t) in zip(block, some):
                    presence(t, row)
                for (i, _), f in zip(some, block[: len(some)] @ weights + offset):
                    best = int(np.argmax(f))
                    names[i], scores[i] = languages[best], min(1.0, max(0.0, (float(f[best]) + 1) / 2))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = fresh("found", docs)
    return docs.select(*kept, scored(F.col(text).cast("string")).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")


def held_out(key: str, folds: int = 5) -> Column:
    """Is the row in the fold that fits must not see? A null key is in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, from a model of the rows that are not held
    out. The label is read for the fit only."""
    rows, labels = sample(docs.where(~held_out(key)), key, text, label)
    found = predict(docs.drop("held_out"), fit(rows, labels) if labels else None, text)
    return found.withColumn("held_out", held_out(key))
