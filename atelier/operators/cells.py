"""Points, polygons and borders on a hierarchy of grid cells.

The edges of polygons are dealt to the cells they cross; a cell that holds more than `most` of
them is cut into 4 by 4 smaller ones, down to the last level. A cell that no edge crosses lies
inside a polygon or outside, so a point in it needs no edge at all; in any other cell a point
meets that cell's edges only, however many vertices the polygon has.

Inside or outside is known of a cell's corner: how many edges lie to the right of it, odd or
even, is a running count along the grid line. From there the parity changes with each edge
between the corner and the point.

The nearest border is found down the same hierarchy: a cell that is further away than some
vertex already met is left, with all that it holds.

Coordinates are degrees; edges are straight in them. Edges do not cross the 180th meridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.operators.position import ensure_checkpoints

#: Degrees of the largest cells, by how much a level divides a cell's side, levels.
LARGEST, BY, LEVELS = 60.0, 4, 8
RADIUS = 6371.0
CELL = ["level", "cx", "cy"]
EDGE = ["x1", "y1", "x2", "y2"]


def side(level: int) -> float:
    return LARGEST / BY**level


def _column(x: Column, level: int) -> Column:
    return F.floor((x + 180) / side(level)).cast("int")


def _row(y: Column, level: int) -> Column:
    return F.floor((y + 90) / side(level)).cast("int")


def _crosses(level: int) -> Column:
    """Does the edge's line have corners of the cell (cx, cy) on both sides, or on it?"""
    s = side(level)
    x, y = F.col("cx") * s - 180, F.col("cy") * s - 90
    sides = [(F.col("x2") - F.col("x1")) * (y + b - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x + a - F.col("x1")) for a in (0.0, s) for b in (0.0, s)]
    return (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _dealt(edges: DataFrame, level: int) -> DataFrame:
    """edges with the cells of a level that they cross; where they have cells of the level
    above, only inside those."""
    ends = {}
    for c, at, up in (("cx", _column, "x"), ("cy", _row, "y")):
        lo, hi = F.least(f"{up}1", f"{up}2"), F.greatest(f"{up}1", f"{up}2")
        a, b = at(lo, level), at(hi, level)
        if level:
            a, b = F.greatest(a, F.col(c) * BY), F.least(b, F.col(c) * BY + BY - 1)
        ends[c] = F.when(a <= b, F.sequence(a, b))
    rows = edges.withColumns({f"_{c}": s for c, s in ends.items()}).drop("cx", "cy")
    rows = rows.withColumn("cx", F.explode("_cx")).withColumn("cy", F.explode("_cy")).drop("_cx", "_cy")
    return rows.where(_crosses(level)).withColumn("level", F.lit(level))


def hierarchy(edges: DataFrame, by: list[str], most: int = 16, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, held, levels used). nodes: level, cx, cy, the columns of by, rx and ry (an end of one of its
    edges), n and leaf, of every cell that edges cross, apart for each value of by. held: the
    edges of the leaves, with their cells."""
    ensure_checkpoints(edges.sparkSession)
    nodes = held = None
    for level in range(levels):
        edges = _dealt(edges, level).checkpoint()
        some = edges.groupBy(*CELL, *by).agg(F.min(F.struct("x1", "y1")).alias("r"), F.count(F.lit(1)).alias("n"))
        some = some.select(*CELL, *by, F.col("r.x1").alias("rx"), F.col("r.y1").alias("ry"), "n", ((F.col("n") <= most) | F.lit(level == levels - 1)).alias("leaf")).checkpoint()
        here = edges.join(some.where("leaf").select(*CELL, *by), [*CELL, *by], "left_semi")
        nodes, held = (some, here) if nodes is None else (nodes.unionByName(some), held.unionByName(here))
        if some.where("NOT leaf").isEmpty():
            break
        edges = edges.join(some.where("NOT leaf").select(*CELL, *by), [*CELL, *by], "left_semi").drop("level")
    return nodes, held, level + 1


def covering(edges: DataFrame, most: int = 16, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(cells, held) of polygons, edges being name, x1, y1, x2, y2: cells (level, cx, cy, name,
    inner, odd) cover them without overlap; held are the edges of the cells that are not inner.
    odd: does the lower left corner lie inside?"""
    nodes, held, levels = hierarchy(edges, ["name"], most, levels)
    box = edges.groupBy("name").agg(*[f(c).alias(n) for n, f, c in (("w", F.min, "x1"), ("e", F.max, "x1"), ("s", F.min, "y1"), ("n", F.max, "y1"))])
    out = None
    for level in range(levels):
        if level == 0:
            both = box.withColumn("cx", F.explode(F.sequence(_column(F.col("w"), 0), _column(F.col("e"), 0))))
            asked = both.withColumn("cy", F.explode(F.sequence(_row(F.col("s"), 0), _row(F.col("n"), 0)))).select("name", "cx", "cy")
        else:
            asked = nodes.where(f"level = {level - 1} AND NOT leaf")
            for c in ("cx", "cy"):
                asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) * BY, F.col(c) * BY + BY - 1)))
            asked = asked.select("name", "cx", "cy")
        s = side(level)
        # where edges cross the lower lines of the rows asked
        lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
        lines = F.sequence(F.ceil((lo + 90) / s).cast("int"), F.floor((hi + 90) / s).cast("int"))
        level_edges = edges.where(F.ceil((lo + 90) / s) <= F.floor((hi + 90) / s)).select("name", *EDGE, F.explode(lines).alias("cy"))
        y = F.col("cy") * s - 90
        crossed = level_edges.where((F.col("y1") > y) != (F.col("y2") > y))
        crossed = crossed.select("name", "cy", (F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))).alias("x"), F.lit(1).alias("e"), F.lit(None).cast("int").alias("cx"))
        corners = asked.select("name", "cy", (F.col("cx") * s - 180).alias("x"), F.lit(0).alias("e"), "cx")
        # from the right: a crossing at a corner's own place is not to the right of it
        right = Window.partitionBy("name", "cy").orderBy(F.desc("x"), "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = corners.unionByName(crossed).withColumn("right", F.sum("e").over(right)).where("cx IS NOT NULL")
        here = nodes.where(f"level = {level}").select("name", "cx", "cy", "leaf")
        cells = counted.join(here, ["name", "cx", "cy"], "left").where("leaf IS NULL OR leaf")
        cells = cells.select(F.lit(level).alias("level"), "cx", "cy", "name", F.col("leaf").isNull().alias("inner"), (F.col("right") % 2 == 1).alias("odd"))
        cells = cells.where("odd OR NOT inner")
        out = cells if out is None else out.unionByName(cells)
    return out.checkpoint(), held


def located(points: DataFrame, cells: DataFrame, held: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(k, name) of the points (k, lat, lng) inside polygons."""
    places = F.array(*[F.struct(F.lit(i).alias("level"), _column(F.col("lng"), i).alias("cx"), _row(F.col("lat"), i).alias("cy")) for i in range(levels)])
    near = points.select("k", "lat", "lng", F.explode(places).alias("c")).select("k", "lat", "lng", "c.*").join(cells, CELL)
    s = F.lit(LARGEST) / F.pow(F.lit(float(BY)), F.col("level"))
    x0, y0 = F.col("cx") * s - 180, F.col("cy") * s - 90
    level_x = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    upright_y = F.col("y1") + (F.col("y2") - F.col("y1")) * (x0 - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    level_hit = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (level_x > x0) & (level_x <= F.col("lng"))
    upright_hit = ((F.col("x1") > x0) != (F.col("x2") > x0)) & (upright_y > y0) & (upright_y <= F.col("lat"))
    met = near.where("NOT inner").join(held.select(*CELL, "name", *EDGE), [*CELL, "name"])
    turns = F.when(level_hit, 1).otherwise(0) + F.when(upright_hit, 1).otherwise(0)
    by_edges = met.groupBy("k", "name").agg(F.sum(turns).alias("n"), F.first("odd").alias("odd")).where("(n % 2 = 1) <> odd")
    return near.where("inner").select("k", "name").unionByName(by_edges.select("k", "name"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres."""
    h = F.pow(F.sin(F.radians((lat1 - lat2) / 2)), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians((lng1 - lng2) / 2)), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def to_edge() -> Column:
    """Kilometres from (lat, lng) to an edge: to the nearest of its ends and of the place that
    is nearest where degrees of longitude count as at the point."""
    narrow = F.cos(F.radians("lat"))
    dx, dy = (F.col("x2") - F.col("x1")) * narrow, F.col("y2") - F.col("y1")
    along = ((F.col("lng") - F.col("x1")) * narrow * dx + (F.col("lat") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    places = [(F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1"))), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))]
    return F.least(*[haversine(F.col("lat"), F.col("lng"), y, x) for x, y in places])


def _at_least(level: int) -> Column:
    """Kilometres from (lat, lng) that no place of the cell (cx, cy) is nearer than."""
    s = side(level)
    w, south = F.col("cx") * s - 180, F.col("cy") * s - 90
    up = F.greatest(F.lit(0.0), south - F.col("lat"), F.col("lat") - south - s)
    # to the nearer of the meridians that bound the cell, over either way round
    gap = F.least(*[F.greatest(F.lit(0.0), w - lng, lng - w - s) for lng in (F.col("lng"), F.col("lng") + 360, F.col("lng") - 360)])
    across = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(F.lit(90.0), gap))))
    return RADIUS * F.greatest(F.radians(up), across)


def nearest_border(points: DataFrame, edges: DataFrame, most: int = 16, levels: int = LEVELS) -> DataFrame:
    """k, name and km of the nearest border of any polygon to every point (k, lat, lng)."""
    nodes, held, levels = hierarchy(edges, [], most, levels)
    roots = [F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy")) for x in range(round(360 / LARGEST)) for y in range(round(180 / LARGEST))]
    asked, leaves = points.select("k", "lat", "lng", F.explode(F.array(*roots)).alias("c")).select("k", "lat", "lng", "c.*"), None
    most_km = None
    for level in range(levels):
        met = asked.join(nodes.where(f"level = {level}").drop("level", "n"), ["cx", "cy"])
        met = met.withColumns({"low": _at_least(level), "high": haversine(F.col("lat"), F.col("lng"), F.col("ry"), F.col("rx"))}).checkpoint()
        high = met.groupBy("k").agg(F.min("high").alias("km"))
        most_km = high if most_km is None else most_km.unionByName(high).groupBy("k").agg(F.min("km").alias("km"))
        kept = met.join(most_km, "k").where(F.col("low") <= F.col("km") * (1 + 1e-12) + 1e-9).select("k", "lat", "lng", F.lit(level).alias("level"), "cx", "cy", "low", "leaf").checkpoint()
        leaves = kept.where("leaf") if leaves is None else leaves.unionByName(kept.where("leaf"))
        asked = kept.where("NOT leaf")
        for c in ("cx", "cy"):
            asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) * BY, F.col(c) * BY + BY - 1)))
        asked = asked.select("k", "lat", "lng", "cx", "cy")
    last = leaves.join(most_km, "k").where(F.col("low") <= F.col("km") * (1 + 1e-12) + 1e-9)
    found = last.select("k", "lat", "lng", *CELL).join(held.select(*CELL, "name", *EDGE), CELL)
    best = found.groupBy("k").agg(F.min(F.struct(to_edge().alias("km"), "name")).alias("b"))
    return best.select("k", "b.name", "b.km")
