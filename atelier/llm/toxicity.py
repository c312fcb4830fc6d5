"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word is a run of letters and digits (and of the signs that stand in for letters); its
subwords are the character n-grams of SIZES, with its borders as characters. N-grams are
hashed to rows of an embedding table. A bag is a window of WORDS words: the mean of its
n-grams' vectors, drawn towards zero by PRIOR, goes into a softmax of two classes. Vectors and
softmax are fitted together, by gradient steps in numpy. A misspelt word shares most of its
n-grams with the word, so it shares their vectors; in the fit a share of each bag's n-grams is
left out at random, so that no n-gram is needed.

Labels are of whole texts, but a few words may make a text toxic. So a text scores as the mean
of its WORST windows does, and the fit takes, of a text with label 1, the windows that the model
then finds worst, and of a text with label 0 every window. Whole texts are read in windows, by
the fit and by the scores. A quarter of the sample is kept from the gradient steps and sets the
level at which a text counts as toxic: fewest errors, where classes are as frequent as among
all labels.

The fit reads a bounded sample of the labelled rows: of each class at most PER_CLASS keys, in
the order of a hash, their texts if no longer than LONGEST, and MOST_CHARS characters in all.
Keys labelled 0 and 1 count as 1, other labels as none; of several texts of a key the least is
read. An empty text, or one without a word, is an empty bag: it scores as the softmax's offsets
say. Where no label is known every score is 0; where all known labels are alike, it is that
label. Columns of docs with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import discard, fresh, written
from atelier.llm.kernel_langid import held_out

#: Sizes of the n-grams, log2 of the hashed rows, numbers of a vector, words of a window.
SIZES, BITS, WIDTH, WORDS = (3, 4, 5), 20, 8, 4
#: Windows that make a text's score, and n-grams without effect that every bag has besides.
WORST, PRIOR = 3, 50
#: Bounds of the fit's sample.
PER_CLASS, LONGEST, MOST_CHARS = 2048, 1 << 17, 1 << 23
#: Passes of the fit, step, windows of a step, share of n-grams left out, the softmax's first
#: difference of offsets, and the power of the ratio of windows by which label 1 weighs more.
PASSES, STEP, BATCH, LEFT_OUT, START, POWER = 6, 0.3, 256, 0.3, -2.0, 0.7
#: Signs that stand in for letters.
SIGNS = "@$*"
RESULTS = ("held_out", "score", "predicted")


def _letters() -> np.ndarray:
    """Is a code point of the basic plane part of a word?"""
    return np.array([chr(i).isalnum() or chr(i) in SIGNS for i in range(1 << 16)])


LETTER = _letters()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, at, starts): the hashed rows of the text's n-grams, the place of each, and the
    places where its windows start. Code points beyond the basic plane are letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = LETTER[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    # borders to both sides, of runs of other characters one is kept
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    p = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint32)
    border = p == 0
    begins = np.flatnonzero(border[:-1] & ~border[1:])
    inside = np.concatenate([[0], np.cumsum(border)])
    h, rows, at = p * np.uint32(0x9E3779B1), [], []
    for n in range(2, max(SIZES) + 1):
        if len(p) < n:
            break
        h = (h[: len(p) - n + 1] ^ (h[: len(p) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + p[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in SIZES:
            # no border inside
            where = np.flatnonzero(inside[n - 1 : len(p)] == inside[1 : len(p) - n + 2])
            rows.append((h[where] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
            at.append(where)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), begins[::WORDS]
    return np.concatenate(rows).astype(np.int64), np.concatenate(at), begins[::WORDS]


class Model:
    """Vectors of n-grams, weights and offsets of the softmax."""

    def __init__(self, seed: int = 0):
        self.random = np.random.default_rng(seed)
        self.vectors = np.zeros((1 << BITS, WIDTH), np.float32)
        self.weights, self.offsets = self.random.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.array([-START / 2, START / 2], np.float32)
        self.seen = np.full(1 << BITS, 1e-6, np.float32)  # squared gradients of a vector

    def flat(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the difference of the two classes, and their offset: the
        mean of vectors times weights is the mean of such products."""
        difference = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ difference).astype(np.float32), float(self.offsets[1] - self.offsets[0])

    def step(self, rows: np.ndarray, bag: np.ndarray, n: int, labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One gradient step over n bags; rows[i] belongs to bag[i]."""
        kept = self.random.random(len(rows)) >= LEFT_OUT
        rows, bag = rows[kept], bag[kept]
        size = (np.bincount(bag, minlength=n) + PRIOR).astype(np.float32)
        v = self.vectors[rows]
        mean = np.stack([np.bincount(bag, v[:, d], n) for d in range(WIDTH)], 1).astype(np.float32) / size[:, None]
        z = mean @ self.weights + self.offsets
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - np.eye(2, dtype=np.float32)[labels]) * weight[:, None]
        back = (error @ self.weights.T) / size[:, None]
        self.weights -= 10 * rate * mean.T @ error / n
        used, place = np.unique(rows, return_inverse=True)
        slope = np.stack([np.bincount(place, back[bag, d], len(used)) for d in range(WIDTH)], 1).astype(np.float32)
        self.seen[used] += (slope * slope).sum(1)
        self.vectors[used] -= rate * slope / np.sqrt(self.seen[used])[:, None]


def windows(rows: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's n-grams by windows, and how many each window has; a text without a
    word is one empty window."""
    if not len(starts):
        return rows[:0], np.zeros(1, np.int64)
    window = np.searchsorted(starts, at, "right") - 1
    return rows[np.argsort(window, kind="stable")].astype(np.int32), np.bincount(window, minlength=len(starts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes, which may be 0."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[ends] - sums[ends - sizes]


def logits(adds: np.ndarray, offset: float, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return offset + _sums(adds[rows], sizes) / (sizes + PRIOR)


def raw(bags: list[tuple], adds: np.ndarray, offset: float) -> np.ndarray:
    """The log odds of label 1 of texts, each given by its windows."""
    return np.array([np.sort(logits(adds, offset, *b))[-WORST:].mean() for b in bags])


def train(bags: list[tuple], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """What each n-gram adds, and the offset, from texts of both classes."""
    rows, sizes = np.concatenate([r for r, _ in bags]), np.concatenate([s for _, s in bags])
    text = np.repeat(np.arange(len(bags)), [len(s) for _, s in bags])
    first, model = np.cumsum(sizes) - sizes, Model()
    label = labels[text]
    clean, toxic = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    chosen = toxic
    for turn in range(PASSES):
        if turn:
            flat = model.flat()
            worth = np.concatenate([logits(*flat, *b) for b in bags])[toxic]
            order = np.lexsort((-worth, text[toxic]))
            of = text[toxic][order]
            chosen = toxic[order][np.arange(len(of)) - np.searchsorted(of, of) < WORST]
        some = np.concatenate([chosen, clean])
        weight = np.where(label[some] == 1, (len(clean) / len(chosen)) ** POWER, 1.0).astype(np.float32)
        deal = model.random.permutation(len(some))
        for lo in range(0, len(deal), BATCH):
            part = deal[lo : lo + BATCH]
            n = sizes[some[part]]
            index = np.repeat(first[some[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bag = np.repeat(np.arange(len(part)), n)
            model.step(rows[index], bag, len(part), label[some[part]], weight[part], STEP * (1 - turn / PASSES))
    return model.flat()


def level(odds: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The log odds from which fewest texts are judged wrongly where label 1 has that share;
    the middle between the two texts that it parts."""
    order = np.argsort(odds)
    wrong = np.where(labels[order] == 1, share / max((labels == 1).sum(), 1), -(1 - share) / max((labels == 0).sum(), 1))
    best = int(np.argmin(np.concatenate([[0.0], np.cumsum(wrong)])))
    ends = np.concatenate([[odds[order[0]] - 1], odds[order], [odds[order[-1]] + 1]])
    return float(ends[best] + ends[best + 1]) / 2


def fit(texts: list[str], labels: list[int], share: float) -> tuple[np.ndarray, float]:
    """What each n-gram adds, and the offset less the level, of a model of texts in no
    particular order; share: of label 1 among all labels."""
    bags, known = [windows(*grams(t)) for t in texts], np.array(labels)
    turn = np.zeros(len(bags), np.int64)
    for c in (0, 1):
        turn[known == c] = np.arange((known == c).sum())
    apart = turn % 4 == 3
    adds, offset = train([b for b, x in zip(bags, apart) if not x], known[~apart])
    if apart.any():
        offset -= level(raw([b for b, x in zip(bags, apart) if x], adds, offset), known[apart], share)
    return adds, offset


def score(text: str | None, adds: np.ndarray, offset: float) -> float:
    """The probability of label 1."""
    return float(1 / (1 + np.exp(-np.clip(raw([windows(*grams(text))], adds, offset)[0], -700, 700))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """The model of the labelled rows that are not held out; (None, score) where they do not
    hold both labels."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"))
    known = known.where((F.col("l") == 0) | (F.col("l") == 1)).where(~held_out("k") & F.col("k").isNotNull())
    known = known.groupBy("k").agg(F.max("l").cast("int").alias("l"))
    counts = {r.l: r["count"] for r in known.groupBy("l").count().collect()}
    lot = [F.xxhash64("k", F.lit("sample")), F.col("k")]
    some = known.where("l = 0").orderBy(*lot).limit(PER_CLASS).unionByName(known.where("l = 1").orderBy(*lot).limit(PER_CLASS))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= LONGEST))
    # at most PER_CLASS keys of each class are sent to every task
    found = written(rows.join(F.broadcast(some), "k").groupBy("k", "l").agg(F.min("t").alias("t")), "labelled")
    sizes = found.select("k", "l", F.length("t").alias("n"), lot[0].alias("h")).orderBy("h", "k").collect()
    keys, held = [], {0: 0, 1: 0}
    for r in sizes:
        if held[r.l] + r.n <= MOST_CHARS // 2:
            held[r.l] += r.n
            keys.append((r.k,))
    chosen = docs.sparkSession.createDataFrame(keys, found.select("k").schema)
    texts = found.join(F.broadcast(chosen), "k").orderBy(*lot).collect()
    discard(found)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if {r.l for r in texts} != {0, 1}:
        return None, float(round(share))
    return fit([r.t for r in texts], [r.l for r in texts], share)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """docs with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        adds, offset = shared.value
        return pa.array([offset if adds is None else score(t.as_py(), adds, offset) for t in texts], pa.float64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    apart, found = fresh("apart", docs), fresh("found", docs)
    rows = docs.withColumn(apart, held_out(f"`{key}`")).withColumn(found, scored(F.col(f"`{text}`").cast("string")))
    return rows.select(*kept, F.col(apart).alias("held_out"), F.col(found).alias("score"), (F.col(found) >= 0.5).cast("int").alias("predicted"))
