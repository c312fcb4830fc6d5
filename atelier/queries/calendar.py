"""Calendar building and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atelier.operators.position import ensure_checkpoints, position_in
from atelier.operators.ring_fold import fill
from atelier.queries.base import query, spark_sql, sql, view

# --- calendar ---
TIERED = "SELECT id, k, title, artist, CASE WHEN fame >= 440 THEN 'medium' WHEN fame >= 400 THEN 'hard' ELSE 'impossible' END AS tier FROM [[w]]"
SEEDED = f"SELECT id, title, artist, tier, row_number() OVER (PARTITION BY tier ORDER BY md5(concat('seed7|', id)), id) - 1 AS pos, count(*) OVER (PARTITION BY tier) AS n FROM ({TIERED}) t"
SLOTS = "(VALUES (0), (1), (2), (3), (4)) AS s(slot)"
DAYS = "(SELECT CAST(x AS BIGINT) AS d FROM {(SELECT explode(sequence(0, 29)) AS x)|(SELECT unnest(range(30)) AS x)}) AS days"
RING = f"""SELECT days.d, p.tier, CAST(s.slot AS BIGINT) AS slot, p.id FROM {DAYS} CROSS JOIN {SLOTS} JOIN ({SEEDED}) p ON p.pos = (days.d * 5 + s.slot) % p.n"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work's tier and its place in the tier's seeded order, without one task a tier:
    the global position in (tier, hash) less the number of works in smaller tiers."""
    fame = F.col("fame")
    tier = F.when(fame >= 440, "medium").when(fame >= 400, "hard").otherwise("impossible")
    works = view(spark, sf_dir, "w").select("id", "title", "artist", "style", "region", "y", tier.alias("tier")).withColumn("h", F.md5(F.concat(F.lit("seed7|"), "id").cast("binary")))
    return position_in(works, ["tier"], [F.asc("h"), F.asc("id")], "pos", "n")


@query(f"SELECT id, tier, pos FROM ({SEEDED}) s")
def cal_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("id", "tier", "pos")


def days(spark: SparkSession, n: int, slots: int = 5) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "d").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")))


@query(RING)
def cal_ring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day d takes places 5d to 5d + 4 of each tier's ring."""
    works = seeded(spark, sf_dir)
    wanted = days(spark, 30).crossJoin(F.broadcast(works.select("tier", "n").distinct())).withColumn("pos", (F.col("d") * 5 + F.col("slot")) % F.col("n"))
    return wanted.join(works, ["tier", "pos"]).select("d", "tier", "slot", "id")


#: Places of a ring that are looked at first; a day they do not fill looks REACH times as far.
REACH = 12


def _ahead(works: DataFrame, todo: DataFrame, step: int, reach: int) -> DataFrame:
    """The works at the next `reach` places of each day's ring, or at all of it, in order."""
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(reach), F.col("n")) - 1))
    wanted = todo.withColumn("slot", slots).withColumn("pos", (F.col("d") * step + F.col("slot")) % F.col("n"))
    return wanted.drop("n").join(works.drop("n"), ["tier", "pos"])


def _filled(todo: DataFrame, pick, enough: str) -> DataFrame:
    """pick(todo, reach) of every day of todo (d, tier, n): days without `enough` are picked
    again with a longer reach, until that is the whole ring."""
    out, reach = None, REACH
    while True:
        found = pick(todo, reach).checkpoint()
        late = F.expr(f"NOT ({enough})") & (F.col("n") > reach)
        out = found.where(~late) if out is None else out.unionByName(found.where(~late))
        todo = found.where(late).select("d", "tier", "n")
        if todo.isEmpty():
            return out
        reach *= REACH


@query(f"""
WITH RECURSIVE ring AS (SELECT id, title, artist, tier, pos, n FROM ({SEEDED}) s),
walk AS (SELECT days.d, t.tier, t.n, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(place BIGINT, id VARCHAR, title VARCHAR, artist VARCHAR)[]) AS got FROM {DAYS} CROSS JOIN (SELECT DISTINCT tier, n FROM ring) t
  UNION ALL SELECT w.d, w.tier, w.n, w.step + 1, CASE WHEN len(list_filter(w.got, lambda g: g.id = r.id OR g.title = r.title OR (r.artist <> '' AND g.artist = r.artist))) > 0 THEN w.got
    ELSE list_append(w.got, {{'place': len(w.got), 'id': r.id, 'title': r.title, 'artist': r.artist}}) END
  FROM walk w JOIN ring r ON r.tier = w.tier AND r.pos = (w.d * 5 + w.step) % w.n WHERE w.step < w.n AND len(w.got) < 5)
SELECT d, tier, g.place, g.id, g.title, g.artist FROM (SELECT d, tier, unnest(got) AS g FROM (SELECT *, row_number() OVER (PARTITION BY d, tier ORDER BY step DESC) AS i FROM walk) x WHERE i = 1) y""")
def cal_ring_window_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the ring, but a title or maker never twice on a day: the first five that differ of
    the places that follow, up to the whole ring."""
    works = seeded(spark, sf_dir).select("id", "title", "artist", "tier", "pos", "n")
    todo = spark.range(30).withColumnRenamed("id", "d").crossJoin(F.broadcast(works.select("tier", "n").distinct()))
    fold = F.expr(
        "aggregate(a, cast(array() as array<struct<slot:bigint,id:string,title:string,artist:string>>), (s, x) -> if(size(s) < 5 and not exists(s, y -> y.id = x.id"
        " or y.title = x.title or (x.artist <> '' and y.artist = x.artist)), array_append(s, x), s))"
    )

    def pick(todo: DataFrame, reach: int) -> DataFrame:
        ahead = _ahead(works, todo, 5, reach).groupBy("d", "tier").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "title", "artist"))).alias("a"))
        return ahead.select("d", "tier", fold.alias("a")).join(todo, ["d", "tier"])

    found = _filled(todo, pick, "size(a) = 5")
    return found.select("d", "tier", F.posexplode("a").alias("place", "x")).select("d", "tier", F.col("place").cast("long"), "x.id", "x.title", "x.artist")


@query(f"""
WITH ring AS (SELECT id, artist, tier, pos, n FROM ({SEEDED}) s),
four AS (SELECT days.d, CAST(s.slot AS BIGINT) AS slot, r.id, r.artist FROM {DAYS} CROSS JOIN {SLOTS} JOIN ring r ON r.tier = 'medium' AND r.pos = (days.d * 4 + s.slot) % r.n WHERE s.slot < 4),
fifth AS (SELECT days.d, r.id, r.artist, row_number() OVER (PARTITION BY days.d ORDER BY (r.pos - days.d % r.n + r.n) % r.n) AS i FROM {DAYS} JOIN ring r ON r.tier = 'hard'
  WHERE EXISTS (SELECT 1 FROM four f WHERE f.d = days.d) AND NOT EXISTS (SELECT 1 FROM four f WHERE f.d = days.d AND f.artist = r.artist))
SELECT * FROM four UNION ALL SELECT d, CAST(4 AS BIGINT), id, artist FROM fifth WHERE i = 1""")
def cal_band_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four works of the first band and one of the second, whose maker is none of theirs: the
    first on the second's ring, all of it if need be."""
    w = seeded(spark, sf_dir).select("id", "artist", "tier", "pos", "n")
    four = days(spark, 30, 4).crossJoin(F.broadcast(w.where("tier = 'medium'").select("n").distinct()))
    four = four.withColumn("pos", (F.col("d") * 4 + F.col("slot")) % F.col("n")).drop("n").join(w.where("tier = 'medium'").drop("n"), "pos").select("d", "slot", "id", "artist")
    makers = four.groupBy("d").agg(F.collect_set("artist").alias("makers")).checkpoint()
    second = w.where("tier = 'hard'")
    todo = makers.select("d").crossJoin(F.broadcast(second.select("tier", "n").distinct()))

    def pick(todo: DataFrame, reach: int) -> DataFrame:
        fits = _ahead(second, todo, 1, reach).join(makers, "d").where(~F.array_contains("makers", F.col("artist")))
        return todo.join(fits.groupBy("d").agg(F.min_by(F.struct("id", "artist"), "slot").alias("x")), "d", "left")

    one = _filled(todo, pick, "x IS NOT NULL").where("x IS NOT NULL").select("d", F.lit(4).cast("long").alias("slot"), "x.id", "x.artist")
    return four.unionByName(one)


SPREAD = "row_number() OVER (PARTITION BY tier, artist ORDER BY h, id) AS a, row_number() OVER (PARTITION BY tier, region, CAST(floor(y / 100.0) AS INT) ORDER BY h, id) AS b"


@query(f"""
SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN artist = '' THEN 1 ELSE a END, b, h, id) - 1 AS pos FROM (
  SELECT *, {SPREAD} FROM (SELECT t.id, t.tier, w.artist, w.region, w.y, md5(concat('seed7|', t.id)) AS h FROM ({TIERED}) t JOIN [[w]] w ON w.id = t.id) x) z""")
def cal_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of one maker as far apart as may be, then those of one region and century: by the
    turn among the maker's works (none where the maker is unknown), then by the turn in
    region and century. Few tiers are no few tasks."""
    works = seeded(spark, sf_dir).withColumn("h", F.md5(F.concat(F.lit("seed7|"), "id").cast("binary")))
    named, unknown = works.where("artist <> ''"), works.where("artist IS NULL OR artist = ''")
    turn = lambda *by: F.row_number().over(Window.partitionBy("tier", *by).orderBy("h", "id"))
    turns = named.withColumn("a", turn("artist")).unionByName(unknown.withColumn("a", F.when(F.col("artist") == "", 1).otherwise(F.lit(None))))
    missing = position_in(turns.where("artist IS NULL"), ["tier"], [F.asc("h"), F.asc("id")], "at").withColumn("a", (F.col("at") + 1).cast("int")).drop("at")
    turns = turns.where("artist IS NOT NULL").unionByName(missing)
    turns = turns.withColumn("b", turn("region", F.floor(F.col("y") / 100.0).cast("int")))
    return position_in(turns.drop("pos", "n"), ["tier"], [F.asc("a"), F.asc("b"), F.asc("h"), F.asc("id")]).select("id", "tier", "pos")


# what is compared of a work: letters and digits of the title, a maker with a name, the style
COMPARED = """SELECT {numbered}, pos, id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', ''{|, 'g'}) AS title,
  CASE WHEN {lower(trim(coalesce(artist, ''))) RLIKE|regexp_matches(lower(trim(coalesce(artist, ''))),} '^(unknown|anon|unidentified)'{|)} THEN '' ELSE lower(trim(coalesce(artist, ''))) END AS maker,
  lower(trim(coalesce(style, ''))) AS style"""
GAP_DAYS = 20


@query(f"""
WITH RECURSIVE seeded AS (SELECT s.*, w.style FROM ({SEEDED}) s JOIN [[w]] w ON w.id = s.id),
ring AS ({COMPARED.replace("{numbered}", "CAST(dense_rank() OVER (ORDER BY tier) - 1 AS INT) AS tier, n")} FROM seeded),
tiers AS (SELECT count(DISTINCT tier) AS n FROM ring),
walk AS (
  SELECT CAST(n_nationkey AS BIGINT) AS edition, CAST(n_nationkey * 37 AS BIGINT) AS first, 0 AS d, 0 AS t, 0 AS p, CAST(0 AS BIGINT) AS k,
    CAST([] AS STRUCT(id VARCHAR, title VARCHAR, maker VARCHAR, style VARCHAR, p INT)[]) AS got, CAST([] AS STRUCT(d INT, t INT, id VARCHAR, maker VARCHAR)[]) AS past,
    false AS closed, CAST([] AS STRUCT(id VARCHAR, title VARCHAR, maker VARCHAR, style VARCHAR, p INT)[]) AS filled FROM nation
  UNION ALL
  SELECT edition, first, CASE WHEN full_ AND t + 1 = nt THEN d + 1 ELSE d END, CASE WHEN full_ THEN (t + 1) % nt ELSE t END,
    CASE WHEN full_ THEN 0 WHEN k + 1 = n THEN p + 1 ELSE p END, CASE WHEN full_ OR k + 1 = n THEN 0 ELSE k + 1 END,
    CASE WHEN full_ THEN [] ELSE now END, CASE WHEN full_ THEN list_concat(list_filter(past, lambda x: d - x.d <= 21), list_transform(now, lambda g: struct_pack(d := d, t := t, id := g.id, maker := g.maker))) ELSE past END,
    full_, now
  FROM (SELECT *, len(now) = 5 OR (p = 2 AND k + 1 = n) AS full_ FROM (
    SELECT w.*, r.n, tiers.n AS nt, CASE WHEN len(list_filter(w.got, lambda g: g.title = r.title OR (r.maker <> '' AND g.maker = r.maker))) > 0
        OR (w.p < 2 AND len(list_filter(w.past, lambda x: x.id = r.id AND w.d - x.d <= 21)) > 0)
        OR (w.p < 1 AND ((r.maker <> '' AND len(list_filter(w.past, lambda x: x.t = w.t AND x.d < w.d AND w.d - x.d <= 5 AND x.maker = r.maker)) > 0)
          OR (r.style <> '' AND len(list_filter(w.got, lambda g: g.style = r.style)) >= 2)))
      THEN w.got ELSE list_append(w.got, struct_pack(id := r.id, title := r.title, maker := r.maker, style := r.style, p := w.p)) END AS now
    FROM walk w CROSS JOIN tiers JOIN ring r ON r.tier = w.t AND r.pos = ((w.first + w.d) * 5 + w.k) % r.n WHERE w.d < {GAP_DAYS}) x) y)
SELECT edition, CAST(CASE WHEN t = 0 THEN d - 1 ELSE d END AS INT) AS d, CAST(CASE WHEN t = 0 THEN (SELECT n FROM tiers) - 1 ELSE t - 1 END AS INT) AS tier,
  CAST(slot - 1 AS INT) AS slot, filled[slot].id AS id, filled[slot].p AS relaxed FROM (SELECT edition, d, t, filled, unnest(range(1, len(filled) + 1)) AS slot FROM walk WHERE closed) z""")
def cal_gap_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edition's calendar, filled day by day from the tiers' seeded rings: at most two of a
    style a day, a maker in a tier again after five days, a work after 21; a title or maker
    never twice in a set. Rules are relaxed in turn where the whole ring has too few works."""
    ensure_checkpoints(spark)
    works = seeded(spark, sf_dir).select("id", "title", "artist", "style", "tier", "pos", "n").checkpoint()
    # a row for each of the few tiers
    rings = sorted((r.tier, r.n) for r in works.select("tier", "n").distinct().collect())
    number = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(rings) for x in (t, i)]) if rings else None
    editions = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edition"), (F.col("n_nationkey") * 37).alias("first"))
    if not rings:
        return spark.createDataFrame([], "edition long, d int, tier int, slot int, id string, relaxed int")
    numbered = works.withColumn("t", number[F.col("tier")])
    ring = spark_sql(spark, sf_dir, COMPARED.replace("{numbered}", "t AS tier") + " FROM [[numbered]]", numbered=numbered).checkpoint()
    return fill(ring, editions, [n for _, n in rings], GAP_DAYS)


sql("cal_preserve_lock", """
WITH old AS (SELECT * FROM [[cal]] WHERE dn < 19710), new AS (SELECT edition, dn, tier, slot, concat('x', id) AS id FROM [[cal]] WHERE dn >= 19705)
SELECT edition, dn, tier, slot, id, 'kept' AS origin FROM old
UNION ALL SELECT n.edition, n.dn, n.tier, n.slot, n.id, 'added' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.edition = n.edition AND o.dn = n.dn AND o.tier = n.tier)""")
sql("cal_visible_horizon", "SELECT DISTINCT id FROM [[cal]] WHERE dn >= 19700 AND dn < 19710")
sql("cal_integrity", """
SELECT c.edition, c.dn, c.tier, count(*) AS slots, CAST(sum(CASE WHEN w.artist = '' OR w.style = '' THEN 1 ELSE 0 END) AS BIGINT) AS thin
FROM [[cal]] c LEFT JOIN [[w]] w ON w.id = c.id GROUP BY c.edition, c.dn, c.tier HAVING count(*) <> 5 OR sum(CASE WHEN w.artist = '' OR w.style = '' THEN 1 ELSE 0 END) > 0""")
sql("cal_tier_meta", "SELECT tier, count(*) AS rotation, count(DISTINCT id) AS works, count(DISTINCT dn) AS days FROM [[cal]] GROUP BY tier")

# --- scoring ---
FACTOR = "CASE tier WHEN 'easy' THEN 1.3 WHEN 'medium' THEN 1.3 WHEN 'hard' THEN 1.35 ELSE 1.4 END"


def bands(x: str) -> str:
    # fixed values: points of a scaled distance in years
    return f"CASE WHEN {x} <= 12 THEN 2500 WHEN {x} <= 20 THEN 2250 WHEN {x} <= 40 THEN 1900 WHEN {x} <= 80 THEN 1300 WHEN {x} <= 160 THEN 700 WHEN {x} <= 320 THEN 250 ELSE 0 END"


GUESS = f"""SELECT e.event_id, e.user_id, e.dn, e.tier, w.id, w.y, w.style, w.artist, w.region, w.k, CAST(e.total % 3000 AS INT) - 1000 AS guess_year
FROM [[e]] e JOIN [[w]] w ON w.k = e.k WHERE e.tier <> 'save'"""
POINTS = f"SELECT *, {bands('dist')} AS pts FROM (SELECT *, abs(guess_year - y) / CAST({FACTOR} AS DOUBLE) AS dist FROM ({GUESS}) g) h"
sql("score_when", f"SELECT event_id, pts FROM ({POINTS}) p")
# a submission's guess is another work, whose attributes are compared with the true one's
GUESSED = f"""SELECT g.event_id, g.tier, g.y, g.artist, g.style, g.region, x.artist AS guess_artist, x.style AS guess_style, x.region AS guess_region
FROM (SELECT *, (k * 31 + event_id * 7) % n.n AS other FROM ({GUESS}) q CROSS JOIN (SELECT count(*) AS n FROM part) n) g JOIN [[w]] x ON x.k = g.other"""
MATERIAL = "(VALUES ('ECONOMY', 'Oil paint', 'paint'), ('SMALL', 'Ink', 'paint'), ('MEDIUM', 'Drawing', 'draw'), ('LARGE', 'Engraving', 'print'), ('PROMO', 'Bronze', 'sculpt'), ('STANDARD', 'Wood', 'sculpt'))"
sql("score_medium", f"""
SELECT g.event_id, a.m AS truth, b.m AS guess, CASE WHEN a.m = b.m THEN 2500 WHEN a.f = b.f THEN 1250 ELSE 0 END AS pts
FROM ({GUESSED}) g JOIN {MATERIAL} AS a(style, m, f) ON a.style = g.style JOIN {MATERIAL} AS b(style, m, f) ON b.style = g.guess_style""")
# movements: the styles of each region, a style being a family, with the years of their works
sql("score_movement", f"""
WITH m AS (SELECT style, region, min(y) AS a, max(y) AS b FROM [[w]] WHERE style <> '' AND region IS NOT NULL GROUP BY style, region),
p AS (SELECT g.event_id, g.tier, x.style = y.style AND x.region = y.region AS same, x.style = y.style AS fam, x.region = y.region AS reg,
  greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / CAST(greatest(1, least(x.b - x.a, y.b - y.a)) AS DOUBLE) AS overlap
  FROM ({GUESSED}) g JOIN m x ON x.style = g.style AND x.region = g.region JOIN m y ON y.style = g.guess_style AND y.region = g.guess_region)
SELECT p.event_id, t.tier, round(CAST(CASE WHEN same THEN 1.0 WHEN NOT fam AND overlap = 0 THEN 0.0
  ELSE (CASE WHEN fam THEN 0.6 ELSE 0 END + 0.25 * overlap + CASE WHEN reg THEN 0.15 ELSE 0 END) * t.cap END * 2500 AS DOUBLE), 4) AS pts
FROM p JOIN (VALUES ('easy', 0.7), ('medium', 0.5), ('hard', 0.35), ('impossible', 0.25)) AS t(tier, cap) ON t.tier = p.tier""")
META = "SELECT artist, min(y) AS first_y, max(y) AS last_y, count(DISTINCT style) AS n_styles, min(region) AS region, count(*) AS n FROM [[w]] WHERE artist <> '' AND region IS NOT NULL GROUP BY artist"
sql("score_maker_meta", META)
# the most of: the maker 1, a school of theirs .45, work within 30 years of it .25, the region .15
sql("score_maker_bonus", f"""
WITH m AS ({META}), s AS (SELECT artist, {{collect_set(style)|list(DISTINCT style)}} AS schools FROM [[w]] WHERE artist <> '' AND style <> '' GROUP BY artist)
SELECT g.event_id, g.artist AS truth, g.guess_artist AS guess, CAST(2500 * greatest(CASE WHEN g.artist = g.guess_artist THEN 1.0 ELSE 0.0 END,
  CASE WHEN {{arrays_overlap|list_has_any}}(s.schools, t.schools) THEN 0.45 ELSE 0.0 END,
  CASE WHEN g.y BETWEEN m.first_y - 30 AND m.last_y + 30 THEN 0.25 ELSE 0.0 END, CASE WHEN m.region = g.region THEN 0.15 ELSE 0.0 END) AS INT) AS bonus
FROM ({GUESSED}) g JOIN m ON m.artist = g.guess_artist LEFT JOIN s ON s.artist = g.artist LEFT JOIN s t ON t.artist = g.guess_artist WHERE g.artist <> ''""")
sql("score_round_total", f"""
SELECT user_id, dn, tier, CAST(sum(greatest(0, pts - 500 * least(3, event_id % 4))) AS BIGINT) AS total, CAST(sum(CASE WHEN pts = 2500 THEN 1 ELSE 0 END) AS BIGINT) AS perfects,
  count(*) AS rounds FROM ({POINTS}) p GROUP BY user_id, dn, tier""")
sql("score_recheck", f"""
SELECT p.event_id, p.pts AS rescored, e.total % 2501 AS claimed, p.pts <> e.total % 2501 AS differs FROM ({POINTS}) p JOIN [[e]] e ON e.event_id = p.event_id WHERE p.pts <> e.total % 2501""")
sql("score_affinity", """
WITH prof AS (SELECT * FROM (VALUES ('orient', 'ASIA', 1600.0, 300.0), ('ancient', 'AFRICA', -500.0, 500.0), ('modern', 'AMERICA', 1900.0, 80.0)) AS v(name, region, mid, spread))
SELECT p.name, w.id, round(CAST(CASE WHEN w.region = p.region THEN 0.4 ELSE 0.1 END AS DOUBLE) + 0.4 * exp(-power((w.y - CAST(p.mid AS DOUBLE)) / CAST(p.spread AS DOUBLE), 2)) + 0.2 * least(1, w.fame / 500), 4) AS affinity
FROM [[w]] w CROSS JOIN prof p WHERE w.fame IS NOT NULL""")
