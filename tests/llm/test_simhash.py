from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from atelier.llm.components import components
from atelier.llm.simhash import _signed, fingerprint, links, near_duplicates, shingles, similar_texts


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(b for s in shingles for b in range(64) if xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, c in votes.items() if 2 * c > len(shingles))


def slow_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉ \t\n\x1c\x0b漢", max_size=80))
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_links(spark, distance):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 1 << 63]
    prints = set(base)
    for x in base:
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            prints.add(y)
    want = {frozenset((_signed(a), _signed(b))) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= distance}
    got = links(spark.createDataFrame([(_signed(x),) for x in prints], "f long"), distance).collect()
    assert len(got) == len(want) and {frozenset(r) for r in got} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = slow_components(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, documents, odd):
    odd = odd.withColumn("f", odd["doc_id"]).withColumn("component", odd["doc_id"])
    for docs in (documents, odd, odd.limit(0)):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        prints = {d: slow_fingerprint(t) for d, t in texts}
        near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
        want = slow_components(near, prints)
        got = near_duplicates(docs).collect()
        assert len(got) == len(texts)
        assert all(r.component_id == want[r.doc_id] and r.fingerprint == f"{prints[r.doc_id]:016x}" for r in got)


def test_similar_texts(spark, documents, odd):
    import random

    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for d, t in rows[:40]:  # copies with a few words changed
        for n in range(3):
            words = t.split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
            rows.append((10_000 + 10 * d + n, " ".join(words)))
    sets = {d: shingles(t, 5) for d, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = slow_components(near, sets)
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and not any(got[d] < want[d] for d in got)
    assert sum(got[d] == want[d] for d in got) >= 0.95 * len(got)
    blank = {r.doc_id: r.component_id for r in similar_texts(odd.withColumn("m", odd.doc_id)).collect()}
    assert len(blank) == odd.count() and blank[0] == blank[1] == blank[2] == 0 and blank[3] == blank[len(blank) - 1] == 3
    assert similar_texts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("words,edits", [(100, 2), (1000, 21), (3000, 64)])
def test_similar_texts_misses_no_pair(spark, words, edits):
    """Copies with edits that bring in new words, just above a Jaccard of 0.8."""
    import random

    rng, rows = random.Random(words), []
    for d in range(0, 60, 2):
        text = [f"w{rng.getrandbits(40)}" for _ in range(words)]
        rows.append((d, " ".join(text)))
        for e in range(edits):
            text[(2 * e + 1) * words // (2 * edits)] = f"e{rng.getrandbits(40)}"
        rows.append((d + 1, " ".join(text)))
        a, b = shingles(rows[-2][1], 5), shingles(rows[-1][1], 5)
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d in got} and len(got) == 60


def test_similar_texts_order_changes_no_result(spark, documents, monkeypatch):
    from atelier.llm import simhash

    want = {r.doc_id: r.component_id for r in similar_texts(documents).collect()}
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    assert {r.doc_id: r.component_id for r in similar_texts(documents).collect()} == want


def _slow_documents(rows):
    """Components of keys: a key is linked to its fingerprints, near fingerprints to each other."""
    prints = [(k, slow_fingerprint(t)) for k, t in rows]
    fs = {f for _, f in prints}
    pairs = [(("f", a), ("f", b)) for a in fs for b in fs if a < b and (a ^ b).bit_count() <= 4]
    pairs += [(("f", f), ("k", k)) for k, f in prints if k is not None]
    group = slow_components(pairs, {("f", f) for f in fs} | {("k", k) for k, _ in rows if k is not None})
    least = {}
    for k, f in prints:
        if k is not None:
            least[group["f", f]] = min(k, least.get(group["f", f], k))
    return sorted(((k, f"{f:016x}", least.get(group["f", f])) for k, f in prints), key=str)


def test_repeated_keys_and_bridges_without_a_key(spark):
    x, y = "the cat sat on the mat", "a quick brown fox jumps over the dog"
    rows = [(1, x), (2, x), (2, y), (3, y), (None, "z y x w"), (7, "z y x w")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _slow_documents(rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    # a chain of fingerprints, each 3 bits from the next, whose middle only a keyless row holds
    import random

    rng, near = random.Random(5), []
    text = [f"w{i}" for i in range(300)]
    for i in range(12):
        near.append((None if i % 3 == 1 else i, " ".join(text)))
        text[rng.randrange(300)] = f"e{i}"
    got = near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _slow_documents(near)
    keyless = near_duplicates(spark.createDataFrame([(None, x), (None, y)], "doc_id long, text string")).collect()
    assert [r.component_id for r in keyless] == [None, None]


def test_without_similar_keeps_one_row_of_each_group(spark):
    from atelier.llm.simhash import without_similar

    x, y, z = (" ".join([*(f"word{i}" for i in range(60)), c]) for c in "xyz")
    other = "an entirely different text of seven words"
    rows = [(None, "alone and without a key at all"), (1, other), (1, other), (1, x), (2, x), (2, "one more text that has no copy"), (None, y), (None, ""), (None, None), (5, z)]
    df = spark.createDataFrame([(k, t, i, "own") for i, (k, t) in enumerate(rows)], "doc_id long, text string, `a.b` int, m string")
    kept = without_similar(df).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "a.b", "m"]
    # a null text counts as an empty one
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=str) == sorted([rows[0], rows[1], rows[3], rows[5], (None, "")], key=str)
    assert without_similar(df.limit(0)).count() == 0


def test_variants_are_not_broadcast(spark):
    """Few fingerprints have 64 rows each, which Spark sizes as the fingerprints."""
    prints = spark.range(3000).select(F.xxhash64("id").alias("f"))
    found = links(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
