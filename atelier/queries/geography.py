"""Geography: containment, distances, rings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.operators import cells
from atelier.operators.intervals import nearest
from atelier.operators.position import ensure_checkpoints
from atelier.queries.base import query, spark_sql, sql

RINGS = {
    "Box": [[(-5, -5), (5, -5), (5, 5), (-5, 5)]],
    "Ell": [[(20, 10), (40, 10), (40, 20), (30, 20), (30, 40), (20, 40)]],
    "Twin": [[(100, -30), (140, -30), (140, -10), (100, -10)], [(60, 30), (90, 30), (75, 60)]],
    "Grid": [[(-100, 20), (-60, 20), (-60, 50), (-100, 50)]],
}
VERTICES = "(VALUES " + ", ".join(f"('{n}', {r}, {s}, {x}.5, {y}.25)" for n, rings in RINGS.items() for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)) + ") AS v(name, ring, seq, x, y)"
VERT = f"SELECT name, ring, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {VERTICES}"
# a ring of 72 vertices round a place of each nation, beside the plain ones
BORDERS = f"""SELECT name, ring, seq, x, y FROM ({VERT}) plain UNION ALL
SELECT concat('N', n_nationkey), 0, i, round(n_nationkey % 5 * 60 - 119.63 + (6 + (n_nationkey + i) % 3 * 0.9) * cos(radians(i * 5)), 6) + 0e0,
  round(floor(n_nationkey / 5) * 25 - 49.79 + (6 + (n_nationkey + i) % 3 * 0.9) * sin(radians(i * 5)), 6) + 0e0
FROM nation, {{(SELECT explode(sequence(0, 71)) AS i)|(SELECT unnest(range(72)) AS i)}} AS v"""
EDGES = f"""SELECT name, ring, x AS x1, y AS y1, coalesce(lead(x) OVER p, first_value(x) OVER p) AS x2, coalesce(lead(y) OVER p, first_value(y) OVER p) AS y2
FROM ({BORDERS}) t WINDOW p AS (PARTITION BY name, ring ORDER BY seq)"""
POINTS = "SELECT c_custkey AS k, CAST(c_custkey * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 53 % 360 - 180 AS DOUBLE) AS lng FROM customer"
# for the oracles: every point with every edge
CROSS = "SUM(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END)"
INSIDE = f"SELECT p.k, e.name FROM ({POINTS}) p JOIN ({EDGES}) e ON TRUE GROUP BY p.k, e.name HAVING {CROSS} % 2 = 1"
KM = "6371 * 2 * asin(sqrt(power(sin(radians(({a} - {b}) / 2)), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians(({c} - {d}) / 2)), 2)))"


def _km(y: str, x: str) -> str:
    return KM.format(a="lat", b=f"({y})", c="lng", d=f"({x})")


BORDER = f"""SELECT k, name, km FROM (SELECT k, name, km, row_number() OVER (PARTITION BY k ORDER BY km, name) AS i FROM (
  SELECT k, name, least({_km('y1 + t * (y2 - y1)', 'x1 + t * (x2 - x1)')}, {_km('y1', 'x1')}, {_km('y2', 'x2')}) AS km FROM (
    SELECT *, greatest(0, least(1, coalesce(((lng - x1) * c * c * (x2 - x1) + (lat - y1) * (y2 - y1)) / nullif(power((x2 - x1) * c, 2) + power(y2 - y1, 2), 0), 0))) AS t
    FROM (SELECT *, cos(radians(lat)) AS c FROM ({POINTS}) p, ({EDGES}) e) a) b) d) f WHERE i = 1"""


def edges_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoints(spark)
    return spark_sql(spark, sf_dir, EDGES).select("name", "x1", "y1", "x2", "y2").checkpoint(), spark_sql(spark, sf_dir, POINTS)


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, points = edges_and_points(spark, sf_dir)
    return cells.located(points, *cells.covering(edges))


@query(INSIDE)
def geo_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside(spark, sf_dir)


@query(f"SELECT p.k, coalesce(min(i.name), 'sea') AS country FROM ({POINTS}) p LEFT JOIN ({INSIDE}) i ON i.k = p.k GROUP BY p.k")
def geo_country_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country of a point, the first by name where borders overlap."""
    one = inside(spark, sf_dir).groupBy("k").agg(F.min("name").alias("name"))
    return spark_sql(spark, sf_dir, POINTS).join(one, "k", "left").select("k", F.coalesce("name", F.lit("sea")).alias("country"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, name and km of the border nearest to each point, and whether any polygon holds it."""
    edges, points = edges_and_points(spark, sf_dir)
    return by_place(points, edges)


def by_place(points: DataFrame, edges: DataFrame) -> DataFrame:
    """measured() of points (k, lat, lng). Points at one place are measured once, and what is found
    joined back, so the work on cells grows with the places."""
    # k of a place is the least of its points'
    places = points.groupBy("lat", "lng").agg(F.min("k").alias("k")).select("k", "lat", "lng").checkpoint()
    held = cells.located(places, *cells.covering(edges)).select("k").distinct().withColumn("held", F.lit(True))
    near = cells.nearest_border(places, edges).join(held, "k", "left").select("k", "name", "km", F.coalesce("held", F.lit(False)).alias("held"))
    found = near.join(places, "k").drop("k")
    return points.join(found, ["lat", "lng"]).select("k", "name", "km", "held")


MEASURED = f"SELECT b.k, b.name, b.km, i.k IS NOT NULL AS held FROM ({BORDER}) b LEFT JOIN (SELECT DISTINCT k FROM ({INSIDE}) h) i ON i.k = b.k"
# fixed values: kilometres of grace, of the full score's radius, and the decay of each tier
GRACE, FULL = 25, 300
DECAY = "(VALUES ('easy', 4500), ('medium', 3000), ('hard', 2000), ('impossible', 1000)) AS t(tier, scale)"


@query(f"SELECT k, name, round(km, 2) AS km, held OR km <= {GRACE} AS counts_inside FROM ({MEASURED}) m")
def geo_border_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("k", "name", F.round("km", 2).alias("km"), (F.col("held") | (F.col("km") <= GRACE)).alias("counts_inside"))


DECAYED = f"round(CASE WHEN held THEN CAST(2500 AS DOUBLE) ELSE 2500 * exp(-greatest(0, km - {FULL}) / CAST(t.scale AS DOUBLE)) END, 1)"


@query(f"SELECT k, name, t.tier, {DECAYED} AS pts FROM ({MEASURED}) m CROSS JOIN {DECAY}")
def geo_distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    # four rows for each point
    return spark_sql(spark, sf_dir, f"SELECT k, name, t.tier, {DECAYED} AS pts FROM [[m]] m CROSS JOIN {DECAY}", m=measured(spark, sf_dir))


@query(f"SELECT k, name, round(CASE WHEN held OR km <= {GRACE} THEN CAST(2500 AS DOUBLE) ELSE 2500 * exp(-km / CAST(4500 AS DOUBLE)) END, 1) AS pts FROM ({MEASURED}) m")
def score_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full points inside and in the belt of grace, fewer with the distance to a border."""
    far = F.round(2500 * F.exp(-F.col("km") / 4500.0), 1)
    return measured(spark, sf_dir).select("k", "name", F.when(F.col("held") | (F.col("km") <= GRACE), 2500.0).otherwise(far).alias("pts"))


# the rings of rings() below, and the mean of each one's vertices
sql("geo_ring_centroid", f"""
SELECT k, round(avg(greatest(-90, least(90, lat + 3 * sin(radians(i * 5))))), 3) + 0e0 AS lat, round(avg(lng + (3 + (k + i) % 3 * CAST(0.4 AS DOUBLE)) * cos(radians(i * 5))), 3) + 0e0 AS lng, count(*) AS n
FROM ({POINTS}) p, {{(SELECT explode(sequence(0, 71)) AS i)|(SELECT unnest(range(72)) AS i)}} AS v GROUP BY k""")
sql("geo_region_extract", f"""
SELECT m.culture, v.name, v.ring, count(*) AS n_vertices FROM (SELECT DISTINCT style AS culture, CASE style WHEN 'PROMO' THEN 'Box' WHEN 'SMALL' THEN 'Twin' ELSE 'Ell' END AS name FROM [[w]] WHERE style <> '') m JOIN ({VERT}) v ON v.name = m.name GROUP BY m.culture, v.name, v.ring""")
# snapshots: the centuries in which a style has works of each region
SNAPSHOTS = "SELECT DISTINCT style, CAST(floor(y / 100.0) * 100 AS BIGINT) AS yr FROM [[w]] WHERE style <> '' AND k % 5 = 0"
MIDDLE = "SELECT style, place, median(y) AS mid FROM [[w]] WHERE style <> '' GROUP BY style, place"


@query(f"""SELECT style, place, mid, yr FROM (SELECT m.style, m.place, m.mid, s.yr, row_number() OVER (PARTITION BY m.style, m.place ORDER BY abs(s.yr - m.mid), s.yr) AS i
  FROM ({MIDDLE}) m LEFT JOIN ({SNAPSHOTS}) s ON s.style = m.style) x WHERE i = 1""")
def geo_era_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of a style that is nearest to the median year of its works of a place."""
    middle, shots = spark_sql(spark, sf_dir, MIDDLE), spark_sql(spark, sf_dir, SNAPSHOTS)
    near = nearest(middle.withColumn("yr", F.col("mid")), shots, ["style"], "yr", 500)
    return near.select("style", "place", "mid", F.col("near").cast("long").alias("yr"))


sql("geo_region_coverage", "SELECT style, count(*) AS works FROM [[w]] WHERE style <> '' AND style NOT IN (SELECT x FROM (VALUES ('PROMO'), ('SMALL')) AS v(x)) GROUP BY style")


def rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The customers' points, and a noisy ring of many vertices round each, cut off at the poles.
    The ring is an expression that is to be used once: a column would be made again for every
    filter that the planner puts under it."""
    circle = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.struct((F.col("lng") + (3 + (F.col("k") + i) % 3 * 0.4) * F.cos(F.radians(i * 5))).alias("x"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + 3 * F.sin(F.radians(i * 5)))).alias("y")))
    return spark_sql(spark, sf_dir, POINTS), circle


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def closed(ring: Column, least: int) -> Column:
    """The ring with its first vertex again at its end; nothing where it has fewer vertices then."""
    shut = bound(ring, lambda a: F.when(F.get(a, F.lit(0)) == F.element_at(a, -1), a).otherwise(F.array_append(a, F.get(a, F.lit(0)))))
    return bound(shut, lambda a: F.when(F.size(a) >= least, a))


RING = f"""SELECT k, i AS seq, lng + (3 + (k + i) % 3 * 0.4) * cos(radians(i * 5)) AS x, greatest(-90, least(90, lat + 3 * sin(radians(i * 5)))) AS y FROM ({POINTS}) p, (SELECT unnest(range(72)) AS i) v"""


@query(f"""
WITH RECURSIVE s AS (SELECT k, seq, round(x * 4) / 4 + 0e0 AS x, round(y * 4) / 4 + 0e0 AS y FROM ({RING}) r),
walk AS (SELECT k, 0 AS seq, x AS lx, y AS ly, true AS kept FROM s WHERE seq = 0 UNION ALL
  SELECT s.k, s.seq, CASE WHEN abs(s.x - w.lx) + abs(s.y - w.ly) >= 0.5 THEN s.x ELSE w.lx END, CASE WHEN abs(s.x - w.lx) + abs(s.y - w.ly) >= 0.5 THEN s.y ELSE w.ly END,
    abs(s.x - w.lx) + abs(s.y - w.ly) >= 0.5 FROM walk w JOIN s ON s.k = w.k AND s.seq = w.seq + 1),
a AS (SELECT k, lx AS x, ly AS y, row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM walk WHERE kept),
e AS (SELECT f.k, f.x, f.y, f.n, NOT (f.x = l.x AND f.y = l.y) AS open FROM a f JOIN a l ON l.k = f.k AND l.i = l.n - 1 WHERE f.i = 0)
SELECT k, CAST(i AS INT) AS seq, x, y FROM (SELECT a.k, a.i, a.x, a.y, a.n + CASE WHEN e.open THEN 1 ELSE 0 END AS total FROM a JOIN e ON e.k = a.k
  UNION ALL SELECT k, n, x, y, n + 1 FROM e WHERE open) z WHERE total >= 4""")
def geo_ring_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices snapped to a quarter degree; one nearer than half a degree to the last kept
    is left out; rings are closed, and dropped under four vertices."""
    points, ring = rings(spark, sf_dir)
    return simplified(points, ring)


def simplified(points: DataFrame, ring: Column) -> DataFrame:
    """k, seq, x and y of the simplified rings of the points (k). Each step is made once a ring."""
    snapped = F.transform(ring, lambda p: F.struct((F.round(p["x"] * 4) / 4 + 0.0).alias("x"), (F.round(p["y"] * 4) / 4 + 0.0).alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    far = lambda a, p: F.abs(p["x"] - F.element_at(a, -1)["x"]) + F.abs(p["y"] - F.element_at(a, -1)["y"]) >= 0.5
    kept = F.aggregate(snapped, none, lambda a, p: F.when((F.size(a) == 0) | far(a, p), F.array_append(a, p)).otherwise(a))
    return points.select("k", F.posexplode(closed(kept, 4)).alias("seq", "p")).select("k", "seq", "p.x", "p.y")


def _clipped(source: str, axis: str, sign: int, bound: int) -> str:
    """The oracle's ring (k, seq, x, y) cut at one side of the box."""
    return f"""(SELECT k, row_number() OVER (PARTITION BY k ORDER BY seq, o) AS seq, x, y FROM (SELECT k, seq, unnest([0, 1]) AS o, unnest([x, x + t * (x2 - x)]) AS x, unnest([y, y + t * (y2 - y)]) AS y,
  unnest([c >= 0, (c >= 0) <> (c2 >= 0)]) AS kept FROM (SELECT *, CASE WHEN c <> c2 THEN c / (c - c2) ELSE 0 END AS t FROM (
    SELECT *, {axis} * {sign} - {bound * sign} AS c, {axis}2 * {sign} - {bound * sign} AS c2 FROM (
      SELECT *, coalesce(lead(x) OVER p, first_value(x) OVER p) AS x2, coalesce(lead(y) OVER p, first_value(y) OVER p) AS y2 FROM {source} s WINDOW p AS (PARTITION BY k ORDER BY seq)) a) b) d) e WHERE kept)"""


CLIPPED = f"({RING})"
for _side in (("x", 1, -60), ("x", -1, 60), ("y", 1, -40), ("y", -1, 40)):
    CLIPPED = _clipped(CLIPPED, *_side)


@query(f"SELECT k, CAST(seq AS INT) AS seq, round(x, 6) AS x, round(y, 6) AS y FROM {CLIPPED} z")
def geo_ring_clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings clipped to a box, one side after another: of each edge the end that is inside
    and the point where it crosses the side are kept, in order. A ring is one row, so a task
    holds one at a time and nothing is sorted or sent."""
    points, ring = rings(spark, sf_dir)
    for axis, sign, limit in (("x", 1, -60.0), ("x", -1, 60.0), ("y", 1, -40.0), ("y", -1, 40.0)):
        ring = bound(ring, cut_at(axis, sign, limit))
    out = points.select("k", F.posexplode(ring).alias("at", "p"))
    return out.select("k", (F.col("at") + 1).alias("seq"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def cut_at(axis: str, sign: int, limit: float) -> Callable[[Column], Column]:
    """What cuts a ring at one side of the box."""

    def kept(ring: Column, p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        c, c2 = (e[axis] * sign - limit * sign for e in (p, q))
        t = F.when(c != c2, c / (c - c2)).otherwise(0.0)
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.array_compact(F.array(F.when(c >= 0, p), F.when((c >= 0) != (c2 >= 0), cross)))

    return lambda ring: F.flatten(F.transform(ring, lambda p, i: kept(ring, p, i)))
