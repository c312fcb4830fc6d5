import numpy as np
import pytest

from atelier.llm import multi_index as m


def test_walk_is_in_order():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    out = m.walk(a, b, counts, np.inf)
    assert sorted(out) == np.flatnonzero(counts.ravel()).tolist()
    sums = (a[:, None] + b).ravel()[out]
    assert (np.diff(sums) >= 0).all()
    some = m.walk(a, b, counts, 10)
    assert some == out[: len(some)] and counts.ravel()[some].sum() >= 10 > counts.ravel()[some[:-1]].sum()


def brute(rows, queries, k=5):
    out = {}
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for q, x in queries:
        x = np.array(x, float)
        s = (v * x).sum(1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(x))
        keep = np.flatnonzero(ids != q)
        out[q] = [(int(ids[i]), s[i]) for i in keep[np.lexsort((ids[keep], -s[keep]))][:k]]
    return out


def ask(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in m.nearest(df, df.where("vec_id % 50 = 0"), **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(4000)]
    want = brute(rows, rows[::50])
    got = ask(spark, rows)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    assert ask(spark, rows, share=1.0) == {q: [(i, pytest.approx(s, abs=1e-14)) for i, s in x] for q, x in want.items()}


def test_odd_vectors_ties_and_copies(spark):
    bad = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 1.0, 1.0], [], [1.0, 2.0]]
    rows = [(1000 + i, v) for i, v in enumerate(bad)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 120)] + [(500, [4.0, 3.0, 2.0, 1.0])]
    got = ask(spark, rows + rows, share=1.0)
    good = [r for r in rows if r[0] < 1000]
    want = brute(good, [r for r in good if r[0] % 50 == 0])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert ask(spark, [(0, [1.0, 1.0])]) == {}
    assert ask(spark, []) == {} and ask(spark, [(0, None)]) == {}
    assert [i for i, _ in ask(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])], share=1.0)[0]] == [1, 2]


def test_repeats_take_no_place(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    want = {q: [i for i, _ in x] for q, x in brute(rows, rows[::50]).items()}
    scaled = [(i, [2 * x for x in v]) for i, v in rows]
    for repeated in (rows * 2, rows + rows[1:9] * 5, rows + scaled):
        got = ask(spark, repeated, share=1.0, n_centroids=1)
        assert {q: [i for i, _ in x] for q, x in got.items()} == want


def test_few_rows_are_all_met(spark):
    rows = [(i, [float(j == i) + 0.1 for j in range(7)]) for i in range(7)]
    assert len(ask(spark, rows)[0]) == 5


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in m.nearest(df, df.where("vec_id = 0"), share=1.0).collect()}
    assert got == {1: pytest.approx(0.5**0.5), 2: pytest.approx(1), 3: pytest.approx(1), 4: pytest.approx(0.5**0.5)}


def clusters(n, rng):
    centres = rng.normal(size=(n // 40, 16))
    return (centres[:, None] + 0.05 * rng.normal(size=(len(centres), 40, 16))).reshape(-1, 16)


def test_clustered_vectors_need_few_candidates():
    rng = np.random.default_rng(1)
    x = m.unit(rng.permutation(clusters(8000, rng)))
    asked = {n: m.candidates(x, n, 5) for n in (8000, 80_000, 8_000_000)}
    assert asked[8000] < 0.15 * 8000 and asked[8_000_000] / 8_000_000 < asked[8000] / 8000
    assert m.candidates(m.unit(rng.normal(size=(4000, 64))), 40_000, 5) > 0.4 * 40_000


def test_recall_of_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(clusters(6000, rng)))]
    want, got = brute(rows, rows[::50]), ask(spark, rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_blocks_hold_all_rows(spark, monkeypatch):
    counts = np.random.default_rng(0).integers(0, 40, (9, 9))
    monkeypatch.setattr(m, "ROWS", 30)
    first, parts = m.blocks(counts)
    held = {}
    for c, (a, n) in enumerate(zip(first, parts)):
        assert n == 1 or counts.ravel()[c] > 30
        for b in range(a, a + n):
            held.setdefault(b, []).append(c)
    assert all(len(c) == 1 or counts.ravel()[c].sum() <= 30 for c in held.values())
    monkeypatch.setattr(m, "QUERIES", 3)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    want = {q: [i for i, _ in x] for q, x in brute(rows, rows[::50]).items()}
    assert {q: [i for i, _ in x] for q, x in ask(spark, rows, share=1.0).items()} == want
