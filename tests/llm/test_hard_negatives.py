import math

import duckdb
import numpy as np
import pytest

from atelier.llm import hard_negatives as h
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, positives=5, negatives=3):
    """All pairs, in exact integers, by the contract's words."""
    clean = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(v)))
    clean = sorted(set(clean), key=lambda r: (r[0], r[1], r[2]))
    whole = {v: [math.floor(256 * x) for x in v] for _, _, v in clean}
    out, done = [], set()
    for a, label, v in clean:
        if a % 50 or a in done:
            continue
        done.add(a)
        pairs = [(sum(x * y for x, y in zip(whole[v], whole[w])), i, other) for i, other, w in clean if i != a]
        pairs.sort(key=lambda p: (-p[0], p[1]))
        for score, i, _ in [p for p in pairs if p[2] == label][:positives]:
            fits = [p for p in pairs if p[2] != label and 50 * score <= 100 * p[0] <= 95 * score]
            out += [(a, i, k + 1, j, score, s) for k, (s, j, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, h.hard_negatives(df, **more).collect()))


def test_table_against_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = mined(df)
    assert got and got == slow([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(h.ORACLE).fetchall())


@pytest.mark.parametrize("partitions", [1, 7])
def test_ties_repeats_and_odd_rows(spark, partitions):
    random = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in random.integers(-2, 5, 3) / 4], int(random.integers(0, 3))) for i in random.integers(0, 160, 700)]
    rows += [(50, [0.5, 0.5, 0.5], 1)] * 40 + [(51 + i, [1.0, 1.0, 1.0], i % 2) for i in range(200)]
    rows += [(None, [1.0], 1), (100, None, 1), (3, [1.0, None], 1), (4, [float("nan")], 1), (5, [float("inf")], 1), (6, [1.0], None), (8, [], 1), (9, [0.9], 0), (150, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert mined(df) == slow(rows)
    assert mined(df, positives=2, negatives=9) == slow(rows, 2, 9)
    # blocks of few anchors give the same rows
    assert mined(df, block=3 * 8 * 2) == slow(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** (20 + i % 5) + 0.25, float(i)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == slow(rows)
    beyond = spark.createDataFrame([(i, [1e300 * (1 + i)], i % 2) for i in range(60)], "vec_id long, embedding array<double>, label int")
    assert all(abs(r[4]) < 2**63 for r in mined(beyond))


def test_zero_scores_and_empty_tables(spark):
    rows = [(50, [0.0], 0), (1, [1.0], 1), (2, [1.0], 0), (60, [1.0], 1)]
    # a window of a positive of score 0 holds only 0, whatever the id
    assert mined(spark.createDataFrame(rows, SCHEMA)) == slow(rows) == [(50, 2, 1, 1, 0, 0), (50, 2, 2, 60, 0, 0)]
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(51, [1.0], 1)], SCHEMA)) == []


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(50, [1.0], 0, 7, 1), (2, [1.0], 0, 8, 2), (3, [0.9], 1, 9, 3)], "vec_id int, embedding array<float>, label int, id long, `a.b` int")
    assert mined(df) == [(50, 2, 1, 3, 65536, 58880)]


def test_keys_sort_as_pairs_do():
    random = np.random.default_rng(0)
    big = 2**63 - 1
    pairs = [(a, s, n, i) for a in (-5, 0, 50) for s in (-big, -1, 0, 1, big) for n in (False, True) for i in (-9, 0, big)]
    random.shuffle(pairs)
    keys = [h.pack(np.array([a]), np.array([s]), n, np.array([i])).tobytes() for a, s, n, i in pairs]
    assert [h.unpack(k) for k in keys] == [(a, s, bool(n), i) for a, s, n, i in pairs]
    assert [h.unpack(k) for k in sorted(keys)] == sorted(((a, s, bool(n), i) for a, s, n, i in pairs), key=lambda p: (p[0], -p[1], p[2], p[3]))
    # the pass holds no pairs: it reads from an endless iterator as rows are asked for
    endless = (k for n in iter(int, 1) for k in sorted(keys))
    assert next(h.mine((h.pack(np.array([0]), np.array([s]), n, np.array([1])).tobytes() for s, n in [(100, False), (90, True)]), 5, 3)) == (0, 1, 1, 1, 100, 90)
    assert next(endless)
