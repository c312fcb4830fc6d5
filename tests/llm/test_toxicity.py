import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atelier.llm import toxicity as t
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def model():
    """Trained on texts of made-up words, some of which hold two words of a small list."""
    random = np.random.default_rng(1)
    parts = ["ta", "ri", "lo", "ne", "sam", "ker", "vin", "dul", "mo", "pe"]
    bad = ["grumbalk", "snodderick", "vexplunt"]
    word = lambda: "".join(random.choice(parts, random.integers(1, 4)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(int(random.integers(20, 200)))]
        if i % 4 == 0:
            for at in random.integers(0, len(words), 3):
                words[at] = str(random.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return t.fit(texts, labels, 0.25), word


def test_grams_are_those_of_words():
    text = "Ab, cde! \n\nx"
    rows, at, starts = t.grams(text)
    # borders count as characters and are never inside: _ab_, _cde_, _x_
    want = sum(max(0, len(w) + 2 - n + 1) for w in ("ab", "cde", "x") for n in t.SIZES)
    assert len(rows) == len(at) == want and len(starts) == 1
    assert sorted(t.grams("AB cde x")[0]) == sorted(rows)
    assert len(set(t.grams("abc")[0]) & set(t.grams("xabc")[0])) > 0
    many = t.grams(" ".join(["word"] * (3 * t.WORDS + 1)))
    found, sizes = t.windows(*many)
    assert len(sizes) == 4 and len(found) == sizes.sum() and sizes[0] == t.WORDS * sizes[3]


def test_misspellings_that_were_never_seen(model):
    fitted, word = model
    clean = lambda: " ".join(word() for _ in range(60))
    assert np.mean([t.score(clean(), *fitted) >= 0.5 for _ in range(60)]) <= 0.05
    for bad in ("grumbalk", "grummbalk snoderick", "vexxplunt grumbalc", "snodderik vexplunnt"):
        assert t.score(f"{clean()} {bad} {clean()} {bad} {clean()} {bad}", *fitted) >= 0.5, bad


def test_long_text_is_read_to_its_end(model):
    fitted, word = model
    long = " ".join(word() for _ in range(5000))
    assert t.score(long, *fitted) < 0.5 <= t.score(f"{long} grumbalk snodderick vexplunt", *fitted)


def test_level_parts_with_fewest_errors():
    assert t.level(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1]), 0.5) == 2.5
    assert t.level(np.array([4.0, 1, 3, 2]), np.array([1, 0, 0, 0]), 0.1) == 3.5


def test_table(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = {r.doc_id: r for r in t.classify(documents, labels).collect()}
    assert len(first) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in first.items())
    # held-out labels, lang and source are not read
    other = labels.withColumn("toxic", F.when(t.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = t.classify(documents.select("doc_id", "text"), other.repartition(3)).collect()
    assert {r.doc_id: r.score for r in again} == {k: r.score for k, r in first.items()}
    known = {r.doc_id: r.toxic for r in labels.collect() if not zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([first[k].predicted == v for k, v in known.items() if k in first]) > 0.9


def test_odd_rows_and_labels(spark, odd):
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    docs = odd.withColumn("score", F.lit("own")).withColumn("a.b", F.lit(1))
    for rows, want in (([], 0.0), ([(1, None), (2, 7), (None, 1)], 0.0), ([(i, 1) for i in range(9)], 1.0), ([(i, 0) for i in range(9)], 0.0)):
        got = t.classify(docs, label(rows)).collect()
        assert len(got) == odd.count() and {r.score for r in got} == {want} and {r.predicted for r in got} == {int(want)}
    both = t.classify(docs, label([(i, i % 2) for i in range(9)] * 2 + [(4, 1)])).collect()
    assert all(0 <= r.score <= 1 for r in both)
    empty = {r.score for r in both if not (r.text or "").strip()}
    assert len(empty) == 1
    assert t.classify(odd.limit(0), label([])).count() == 0
