import numpy as np
import pytest

from atelier.llm import kernel_langid as k


def grams(text, n):
    text = text.lower()
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def test_presence_products_are_kernels():
    texts = ["The cat sat on the mat", "Le chat était là", "Der Hund", "é"]
    rows = np.zeros((len(texts), k.WIDTH), np.float32)
    for row, t in zip(rows, texts):
        k.presence(t, row)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = sum(
                w * len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n, _, w in k.SPECTRA if grams(a, n) and grams(b, n)
            )
            assert rows[i] @ rows[j] == pytest.approx(want, abs=0.02)


def test_held_out_accuracy(documents):
    rows = [r for r in k.identify(documents).collect() if r.held_out and r.lang]
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    from pyspark.sql import functions as F

    first = {r.doc_id: (r.lang_pred, r.score) for r in k.identify(documents).collect()}
    hidden = documents.withColumn("lang", F.when(~k.held_out("doc_id"), F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in k.identify(hidden).collect()} == first


def test_odd_rows(spark, documents, odd):
    both = documents.unionByName(odd.withColumn("doc_id", odd.doc_id + 10**6))
    got = {r.doc_id - 10**6: r for r in k.identify(both.withColumn("score", both.doc_id)).collect() if r.doc_id >= 10**6}
    texts = {r.doc_id: r.text for r in odd.collect()}
    for i, t in texts.items():
        blank = not t or not any(c.isalpha() for c in t)
        assert (got[i].lang_pred == "und") == blank and (got[i].score == 0.0 if blank else True)
    assert k.identify(odd.limit(0)).count() == 0
    from pyspark.sql import functions as F

    none = k.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(texts) and {r.lang_pred for r in none} == {"und"}


def test_sample_is_held_as_bits_of_full_kernels(spark):
    import numpy as np

    from atelier.llm import kernel_langid as k

    docs = spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string")
    bits, labels = k.sample(docs, "doc_id", "text", "lang")
    row = np.zeros(k.WIDTH, np.float32)
    k.presence("the cat", row)
    assert bits.dtype == np.uint8 and labels == ["en"] and np.allclose(k.unpacked(bits)[0], row)
    assert (k.MOST_SAMPLE, k.MOST_LANDMARKS) == (8192, 512)


def test_many_labels_and_clashing_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(k, "MOST_LABELS", 3)
    words = ["abc abd", "xyz xyw", "mno mnp", "rare one"]
    rows = [(i, words[i % 3 if i < 90 else 3], "lang%d" % (i % 3 if i < 90 else 3 + i)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("score", F.lit(3))
    got = k.identify(docs).collect()
    assert len(got) == 100 and {r.lang_pred for r in got} == {"lang0", "lang1", "lang2"}
    assert all(r.lang_pred == r.lang and r.found == 1 and r._found == 2 for r in got if r.doc_id < 90)


def test_landmarks_come_near_the_exact_kernel():
    """With every text a landmark, the ridge regression is the one on the whole kernel matrix."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(40)) for a in ("abcdef ", "defghi ", "hijklm ") for _ in range(20)]
    labels = [x for x in "abc" for _ in range(20)]
    rows = np.zeros((60, k.WIDTH), np.float32)
    for row, t in zip(rows, texts):
        k.presence(t, row)
    bits = np.packbits(rows > 0, axis=1)
    names, coefficients, offset = k.fit(bits, labels, landmarks=60)
    z = k.unpacked(bits).astype(np.float64)
    kernel, y = z @ z.T, np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    centred = kernel - kernel.mean(0) - kernel.mean(1)[:, None] + kernel.mean()
    values = np.linalg.eigvalsh(kernel)
    kept = (values > 1e-6 * values[-1]).sum()
    lam = k.RIDGE * np.trace(centred) / kept
    exact = centred @ np.linalg.solve(centred + lam * np.eye(60), y - y.mean(0)) + y.mean(0)
    assert np.abs(z @ coefficients + offset - exact).max() < 0.02


@pytest.mark.parametrize("key", [None, 3, 4, 7, 8])
def test_one_key_holds_all_rows(spark, key):
    """The sample is drawn by key and text, so one key neither fills nor empties it."""
    rows = [(key, f"{'the cat and the hat' if i % 2 else 'le chat et la souris'} {i}", "en" if i % 2 else "fr") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits, labels = k.sample(docs, "doc_id", "text", "lang")
    assert labels.count("en") == labels.count("fr") == k.PER_LABEL == len(bits) // 2
    assert all(r.lang_pred == r.lang for r in k.identify(docs).collect())


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = [(1, "the cat", "en")] * 3000 + [(i, f"the dog {i}", "en") for i in range(2, 1002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits, labels = k.sample(docs, "doc_id", "text", "lang")
    assert 190 <= len(labels) <= k.PER_LABEL
    assert len({b.tobytes() for b in bits}) >= len(labels) - 60
