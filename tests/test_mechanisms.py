"""Cells, intervals, nearest rows and vocabularies against brute force on small random tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atelier.operators import cells, intervals, vocabulary

EDGES = "name string, x1 double, y1 double, x2 double, y2 double"


def star(name, x, y, r, n, rng):
    ring = [(x + r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * i / n), y + r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [(name, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]


def polygons(seed, n):
    rng = random.Random(seed)
    return [e for i in range(6) for e in star(f"p{i % 5}", rng.uniform(-150, 150), rng.uniform(-60, 60), rng.uniform(0.3, 28), n, rng)]


def points(seed, n, edges):
    rng = random.Random(seed)
    out = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(e[2] + rng.gauss(0, 0.2), e[1] + rng.gauss(0, 0.2)) for e in rng.choices(edges, k=n)]
    return [(k, *p) for k, p in enumerate(out)]


@pytest.mark.parametrize("most", [2, 16])
def test_points_in_polygons(spark, most):
    edges = polygons(1, 40)
    some = points(2, 150, edges)
    got = cells.located(spark.createDataFrame(some, "k long, lat double, lng double"), *cells.covering(spark.createDataFrame(edges, EDGES), most))
    want = set()
    for k, y, x in some:
        for name in {e[0] for e in edges}:
            hits = sum((a[2] > y) != (a[4] > y) and x < (a[3] - a[1]) * (y - a[2]) / (a[4] - a[2]) + a[1] for a in edges if a[0] == name)
            if hits % 2:
                want.add((k, name))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_edges_met_do_not_grow_with_vertices(spark):
    """Ten times the vertices: a point still meets the edges of its cell only."""
    met = []
    for n in (50, 500):
        edges = polygons(3, n)
        place = spark.createDataFrame(points(4, 150, polygons(3, 50)), "k long, lat double, lng double")
        _, held = cells.covering(spark.createDataFrame(edges, EDGES))
        most = held.groupBy(*cells.CELL, "name").count().agg(F.max("count")).first()[0]
        met.append(most)
        plan = cells.located(place, *cells.covering(spark.createDataFrame(edges, EDGES)))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert met[0] <= 16 and met[1] <= 16


@pytest.mark.parametrize("most", [3, 16])
def test_nearest_border(spark, most):
    edges = polygons(5, 30)
    some = points(6, 60, edges)
    got = cells.nearest_border(spark.createDataFrame(some, "k long, lat double, lng double"), spark.createDataFrame(edges, EDGES), most)

    def km(a, b, c, d):
        h = math.sin(math.radians((a - c) / 2)) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians((b - d) / 2)) ** 2
        return 2 * cells.RADIUS * math.asin(min(1, math.sqrt(h)))

    found = {r.k: (r.km, r.name) for r in got.collect()}
    assert len(found) == len(some)
    for k, y, x in some:
        best = []
        for name, x1, y1, x2, y2 in edges:
            c = math.cos(math.radians(y))
            t = ((x - x1) * c * (x2 - x1) * c + (y - y1) * (y2 - y1)) / (((x2 - x1) * c) ** 2 + (y2 - y1) ** 2)
            t = min(1, max(0, t))
            best.append((min(km(y, x, y1 + t * (y2 - y1), x1 + t * (x2 - x1)), km(y, x, y1, x1), km(y, x, y2, x2)), name))
        assert found[k][0] == pytest.approx(min(best)[0], rel=1e-9, abs=1e-6)


def test_overlapping_intervals(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(3), lo := rng.randrange(-500, 500), lo + rng.choice([0, 3, 40, 700])) for i in range(120)]
    a = spark.createDataFrame(rows, "a long, g int, a_lo int, a_hi int")
    b = spark.createDataFrame(rows, "b long, g int, b_lo int, b_hi int")
    got = sorted((r.a, r.b) for r in intervals.overlapping(a, b, ["g"], 50).collect())
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert "NestedLoop" not in intervals.overlapping(a, b, ["g"], 50)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_nearest_row(spark, width):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.randrange(-50, 50)) for i in range(80)]
    others = [(rng.choice("ab"), rng.randrange(-60, 60)) for _ in range(12)]
    got = intervals.nearest(spark.createDataFrame(rows, "i long, g string, at int"), spark.createDataFrame(others, "g string, at int"), ["g"], "at", width)
    want = {i: min((v for h, v in others if h == g), key=lambda v: (abs(v - at), v), default=None) for i, g, at in rows}
    assert {r.i: r.near for r in got.collect()} == want


def test_mentions(spark):
    rng = random.Random(9)
    words = ["red", "sea", "dead", "school", "of", "paris"]
    terms = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(40)})
    texts = [(i, rng.choice(["", " ", "!? "]).join([""] + rng.choices(["Red ", "sea ", "dead-", "School ", "of,", "Paris.", "reds "], k=rng.randrange(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    docs, vocab = spark.createDataFrame(texts, "i long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    import re

    plain = {i: f" {' '.join(w for w in re.split(r'[^a-z0-9]+', (t or '').lower()) if w)} " for i, t in texts}
    want = {(i, t) for i, p in plain.items() for t in terms if f" {t} " in p}
    found = vocabulary.mentions(docs, vocab, "i", "text")
    assert {tuple(r) for r in found.collect()} == want and want
    outer = {tuple(r) for r in vocabulary.outermost(found, vocab, "i").collect()}
    assert outer == {(i, t) for i, t in want if not any(j == i and u != t and f" {t} " in f" {u} " for j, u in want)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert vocabulary.mentions(docs, vocab.limit(0), "i", "text").count() == 0


def test_golden_box(spark):
    """A ring that repeats its first vertex; inside, outside, and a point without a region."""
    ring = [(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5), (-5, -5)]
    edges = spark.createDataFrame([("box", *map(float, a + b)) for a, b in zip(ring, ring[1:])], EDGES)
    place = spark.createDataFrame([(1, 0.0, 0.0), (2, 20.0, 20.0), (3, 4.9, -4.9)], "k long, lat double, lng double")
    assert {(r.k, r.name) for r in cells.located(place, *cells.covering(edges)).collect()} == {(1, "box"), (3, "box")}
    assert cells.located(place, *cells.covering(edges.limit(0))).count() == 0


def test_ancestors_and_clusters(spark):
    from atelier.operators import graph

    rng = random.Random(10)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(35)] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    want = {}
    for s in {e[0] for e in edges}:
        seen, near, depth = {s}, {s}, 0
        while near:
            near, depth = {b for a, b in edges if a in near} - seen, depth + 1
            want |= {(s, o): depth for o in near}
            seen |= near
    got = {(r.s, r.o): r.depth for r in graph.ancestors(spark.createDataFrame(edges, "s string, o string")).collect()}
    assert got == want
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(22)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({x for e in links for x in e} | {500})
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = graph.clusters(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.cluster for r in found} == least


def test_golden_guards(spark):
    from atelier.functions import text
    from atelier.functions.dialect import SPARK

    rows = [
        ("Mask", "", 900.0, 0.0), ("Mask", "Someone", 900.0, 900.0), ("Vessel fragment", "", 5.0, 0.0), ("“Untitled”.", "", 50.0, 0.0),
        ("Strigil", "", 820.0, 0.0), ("Garden Carpet", "", 782.0, 0.0), ("Opium Pipe", "", 729.0, 0.0), ("Opium Pipe", "", 300.0, 300.0),
        ("Head of a king", "", 500.0, 500.0), ("Book of Hours", "", 500.0, 500.0), ("Kanon 5", "", 500.0, 500.0), ("Panel: saints", "", 500.0, 500.0), ("Three bare words", "", 500.0, 500.0),
    ]
    df = spark.createDataFrame(rows, "title string, artist string, score double, want double").selectExpr("*", f"{text.guarded(SPARK, 'score', 'title', 'artist')} AS got")
    assert [r.title for r in df.collect() if r.got != r.want] == []


def test_golden_families(spark):
    from atelier.functions import text
    from atelier.functions.dialect import SPARK

    rows = [("Oil on panel", "paint"), ("Gelatin silver print", "craft"), ("Engraving on copperplate", "print"), ("Carved olive pit", "sculpt"), ("Carved ivory", "sculpt"), ("scene\nin ivory", "sculpt"), ("ivory black on paper", "paint"), ("pencil", "draw"), ("wax", ""), ("Carving", ""), ("", "")]
    df = spark.createDataFrame(rows, "x string, want string").selectExpr("*", f"{text.medium_family(SPARK, text.medium_bucket(SPARK, 'x'))} AS got")
    assert [tuple(r) for r in df.collect() if r.got != r.want] == []


@pytest.mark.parametrize("name", ["join_range_overlap", "fn_era_band", "geo_era_snapshot", "join_contains_vocab", "dedup_jaccard_clusters", "win_board_page"])
def test_plans_without_nested_loops(spark, sf, name):
    from atelier.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name != "win_board_page" or "WindowGroupLimit" in plan


def test_division(spark):
    from atelier.operators import tables

    chosen = [(1, "region", "a"), (1, "region", "b"), (1, "style", "x"), (2, "style", "y"), (2, "style", "y"), (3, "region", "c")]
    facets = [("i", "region", "a"), ("i", "style", "x"), ("j", "region", "b"), ("j", "style", "y"), ("j", "style", "x"), ("k", "region", "a"), ("k", "style", None), ("l", "style", "y")]
    got = tables.divided(spark.createDataFrame(chosen, "e int, family string, value string"), spark.createDataFrame(facets, "id string, family string, value string"), "e", "id")
    assert sorted(map(tuple, got.collect())) == [(1, "i"), (1, "j"), (2, "j"), (2, "l")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
