"""The calendar's fold against a slow version that holds every ring, by the written rules."""

import random

import pytest

from atelier.operators import ring_fold as r


def slow(rings, first, days):
    """rings: for each tier (id, title, maker, style) in order."""
    out, works, makers = [], {}, {}
    for d in range(days):
        today = []
        for t, ring in enumerate(rings):
            n, got = len(ring), []
            begin = (first + d) * 5 % n
            for relaxed in range(3):
                for k in range(n):
                    i, title, maker, style = ring[(begin + k) % n]
                    if len(got) == 5:
                        break
                    if any(title == g[1] or (maker and maker == g[2]) for g in got):
                        continue
                    if relaxed < 2 and (i in today or d - works.get(i, -99) <= 21):
                        continue
                    if relaxed < 1 and ((maker and d - makers.get((t, maker), -99) <= 5) or (style and sum(style == g[3] for g in got) >= 2)):
                        continue
                    got.append((i, title, maker, style, relaxed))
            out += [(d, t, slot, g[0], g[4]) for slot, g in enumerate(got)]
            today += [g[0] for g in got]
            for g in got:
                makers[t, g[2]] = d
        for i in today:
            works[i] = d
    return out


def made(seed, sizes, makers=12, styles=4):
    rng = random.Random(seed)
    return [[(f"w{rng.randrange(sum(sizes))}" if seed % 2 else f"{t}-{i}", f"t{rng.randrange(2 * n)}", f"m{m}" if (m := rng.randrange(makers)) else "", f"s{s}" if (s := rng.randrange(styles)) else "") for i in range(n)] for t, n in enumerate(sizes)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("reach", [1, 3, 50])
def test_resumed_walks_equal_one_walk(seed, reach):
    """The state stands at any place, so pieces of any size give the same calendar."""
    rings, rules = made(seed, [random.Random(seed).randrange(3, 90) for _ in range(3)]), r.Rules()
    sizes, s, got = [len(x) for x in rings], r.begun(), []
    while s["d"] < 30:
        places = {}
        for t, n in enumerate(sizes):
            at = r.start(seed, s["d"] + (t < s["t"]), n, rules) + (s["k"] if t == s["t"] else 0)
            places |= {(t, (at + i) % n): rings[t][(at + i) % n] for i in range(min(n, reach))}
        got += r.walk(s, seed, sizes, 30, places, rules)
        assert len(s["works"]) <= 22 * 15 and len(s["makers"]) <= 6 * 15
    assert got == slow(rings, seed, 30)


def test_fill(spark):
    rings = made(4, [70, 9, 120], makers=4)
    rows = [(t, p, *w) for t, ring in enumerate(rings) for p, w in enumerate(ring)]
    ring = spark.createDataFrame(rows, "tier int, pos long, id string, title string, maker string, style string")
    editions = spark.createDataFrame([(e, 37 * e) for e in range(2)], "edition long, first long")
    got = r.fill(ring, editions, [70, 9, 120], 4, reach=12, most=60).collect()
    for e in range(2):
        assert sorted((x.d, x.tier, x.slot, x.id, x.relaxed) for x in got if x.edition == e) == slow(rings, 37 * e, 4)
    assert {x.relaxed for x in got} == {0, 1, 2}
