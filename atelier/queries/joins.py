"""Filters, joins and deduplication over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atelier.functions import rules, text
from atelier.functions.dialect import DUCK, SPARK, column
from atelier.operators import tables
from atelier.operators.graph import below, clusters
from atelier.operators.intervals import overlapping
from atelier.operators.vocabulary import mentions, outermost, stored, tokens
from atelier.plans.views import duck_sql
from atelier.queries.base import ORACLES, QUERIES, query, spark_sql, sql, view
from atelier.queries.scalars import sql_pair

# --- filters ---
sql_pair("item_categories", lambda d: f"""
SELECT id, CASE WHEN movement <> '' THEN movement ELSE culture END AS style, CASE WHEN movement <> '' THEN 'movement' WHEN culture <> '' THEN 'culture' ELSE '' END AS kind,
  concat_ws(',', 'when', 'where', CASE WHEN movement <> '' OR culture <> '' THEN 'style' END, CASE WHEN artist <> '' THEN 'artist' END) AS cats FROM [[c]]""")
sql("norm_required", "SELECT id, year, image, place IS NULL AS no_place FROM [[c]] WHERE year IS NOT NULL AND year <> 0 AND image <> ''")


@query("""
WITH x AS (SELECT 'no_year' AS reason FROM [[c]] WHERE year IS NULL UNION ALL SELECT 'no_image' FROM [[c]] WHERE image = ''
  UNION ALL SELECT 'no_artist' FROM [[c]] WHERE coalesce(artist, '') = '' UNION ALL SELECT 'modern' FROM [[c]] WHERE year > 1900)
SELECT reason, count(*) AS n FROM x GROUP BY reason""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "c")
    rules = [
        ("warn", "no_year", F.col("year").isNull()), ("warn", "no_image", F.col("image") == ""),
        ("warn", "no_artist", tables.blank(F.col("artist"))), ("warn", "modern", F.col("year") > 1900),
    ]
    return tables.violations(c, "id", rules).groupBy(F.col("rule").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


sql("filter_playable", "SELECT w.id FROM [[w]] w WHERE w.k % 34 <> 30 OR w.style IN (SELECT x FROM (VALUES ('PROMO'), ('SMALL')) AS v(x)) OR w.style_kind = 'culture'")
sql("filter_copyright_safe", """
SELECT w.id, w.y, d.last_death FROM [[w]] w LEFT JOIN (
  SELECT a.s, max(CAST(b.o AS INT)) AS last_death, count(b.o) AS known, count(*) AS makers FROM [[t]] a LEFT JOIN [[t]] b ON b.s = a.o AND b.p = 'P570' WHERE a.p = 'P170' GROUP BY a.s) d
ON d.s = w.id WHERE d.s IS NULL OR w.y < 1930 OR d.last_death <= 1955""")
sql("filter_mode_cap", """
SELECT w.id, w.y, m.mode FROM [[w]] w JOIN (VALUES ('movement', 'early', 1000), ('culture', 'any', 99999)) AS m(kind, mode, cap) ON m.kind = w.style_kind WHERE w.y < m.cap""")
# the cohort of each year: made 96 years before, with an image, and not in the last run's list
sql("filter_pd_cohort", """
SELECT c.year, w.id FROM [[w]] w JOIN (SELECT DISTINCT CAST(substr(CAST(o_orderdate AS {STRING|VARCHAR}), 1, 4) AS INT) AS year FROM orders) c ON w.y = c.year - 96
LEFT ANTI JOIN (SELECT concat('w', k) AS id FROM [[c]] WHERE src_priority = 0) last ON last.id = w.id WHERE w.img <> ''""",
    oracle="""
SELECT year, id FROM (SELECT w.y + 96 AS year, w.id FROM [[w]] w WHERE w.img IS NOT NULL AND w.img <> '' AND w.k % 5 <> 0) x WHERE year IN (SELECT year(o_orderdate) FROM orders)""")
sql_pair("filter_non_entity", lambda d: f"SELECT DISTINCT s FROM [[t]] WHERE p = 'P31' AND {d.match('lower(o)', 'promo|city|taxon|building')}")
sql("filter_year_window", "SELECT w.id, w.y FROM [[w]] w WHERE w.y BETWEEN 1400 AND 1600 AND w.id IN (SELECT s FROM [[t]] WHERE p = 'P186' AND o IN ('oil paint', 'wood')) AND w.title NOT LIKE '%ring%'")
# what each edition has selected: (family, value); a family without a row is no limit
SELECTED = """SELECT n_nationkey AS edition, 'region' AS family, r_name AS value FROM nation JOIN region ON (r_regionkey + n_nationkey) % 3 = 0 WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT n_nationkey, 'style', p.style FROM nation JOIN (SELECT DISTINCT p_type AS style, length(p_type) AS n FROM part) p ON (p.n + n_nationkey) % 2 = 0 WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_nationkey, 'source', b.src FROM nation JOIN (SELECT DISTINCT p_brand AS src, length(p_brand) + ascii(substr(p_brand, -1)) AS n FROM part) b ON (b.n + n_nationkey) % 5 < 2"""
FACETS = """SELECT id, 'region' AS family, region AS value FROM [[w]] WHERE region IS NOT NULL UNION ALL SELECT id, 'style', style FROM [[w]] WHERE style <> '' UNION ALL SELECT id, 'source', src FROM [[w]]"""


@query(f"""
WITH sel AS ({SELECTED}), v AS ({FACETS}), families AS (SELECT DISTINCT edition, family FROM sel)
SELECT s.edition, w.id FROM (SELECT DISTINCT edition FROM sel) s CROSS JOIN [[w]] w WHERE NOT EXISTS (
  SELECT 1 FROM families f WHERE f.edition = s.edition AND NOT EXISTS (SELECT 1 FROM sel x JOIN v ON v.family = x.family AND v.value = x.value WHERE x.edition = f.edition AND x.family = f.family AND v.id = w.id))""")
def filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of each edition's selection, by relational division: one of the values of
    every family that it has selected."""
    return tables.divided(spark_sql(spark, sf_dir, SELECTED), spark_sql(spark, sf_dir, FACETS), "edition", "id")


# the cohort of each year: made 96 years before, with an image, and not in the last run's list
sql("filter_pd_cohort", """
SELECT c.year, w.id FROM [[w]] w JOIN (SELECT DISTINCT CAST(substr(CAST(o_orderdate AS {STRING|VARCHAR}), 1, 4) AS INT) AS year FROM orders) c ON w.y = c.year - 96
LEFT ANTI JOIN (SELECT concat('w', k) AS id FROM [[c]] WHERE src_priority = 0) last ON last.id = w.id WHERE w.img <> ''""",
    oracle="""
SELECT year, id FROM (SELECT w.y + 96 AS year, w.id FROM [[w]] w WHERE w.img IS NOT NULL AND w.img <> '' AND w.k % 5 <> 0) x WHERE year IN (SELECT year(o_orderdate) FROM orders)""")
sql_pair("filter_non_entity", lambda d: f"SELECT DISTINCT s FROM [[t]] WHERE p = 'P31' AND {d.match('lower(o)', 'promo|city|taxon|building')}")
sql("filter_year_window", "SELECT w.id, w.y FROM [[w]] w WHERE w.y BETWEEN 1400 AND 1600 AND w.id IN (SELECT s FROM [[t]] WHERE p = 'P186' AND o IN ('oil paint', 'wood')) AND w.title NOT LIKE '%ring%'")
# what each edition has selected: (family, value); a family without a row is no limit
SELECTED = """SELECT n_nationkey AS edition, 'region' AS family, r_name AS value FROM nation JOIN region ON (r_regionkey + n_nationkey) % 3 = 0 WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT n_nationkey, 'style', p.style FROM nation JOIN (SELECT DISTINCT p_type AS style, length(p_type) AS n FROM part) p ON (p.n + n_nationkey) % 2 = 0 WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_nationkey, 'source', b.src FROM nation JOIN (SELECT DISTINCT p_brand AS src, length(p_brand) + ascii(substr(p_brand, -1)) AS n FROM part) b ON (b.n + n_nationkey) % 5 < 2"""
FACETS = """SELECT id, 'region' AS family, region AS value FROM [[w]] WHERE region IS NOT NULL UNION ALL SELECT id, 'style', style FROM [[w]] WHERE style <> '' UNION ALL SELECT id, 'source', src FROM [[w]]"""


@query(f"""
WITH sel AS ({SELECTED}), v AS ({FACETS}), families AS (SELECT DISTINCT edition, family FROM sel)
SELECT s.edition, w.id FROM (SELECT DISTINCT edition FROM sel) s CROSS JOIN [[w]] w WHERE NOT EXISTS (
  SELECT 1 FROM families f WHERE f.edition = s.edition AND NOT EXISTS (SELECT 1 FROM sel x JOIN v ON v.family = x.family AND v.value = x.value WHERE x.edition = f.edition AND x.family = f.family AND v.id = w.id))""")
def filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of each edition's selection, by relational division: one of the values of
    every family that it has selected."""
    chosen = spark_sql(spark, sf_dir, SELECTED).distinct()
    asked = chosen.groupBy("edition").agg(F.countDistinct("family").alias("asked"))
    met = chosen.join(spark_sql(spark, sf_dir, FACETS), ["family", "value"]).groupBy("edition", "id").agg(F.countDistinct("family").alias("met"))
    return met.join(asked, "edition").where("met = asked").select("edition", "id")


sql("validate_submission", """
SELECT event_id, user_id, tier, greatest(0, least(total, 10000)) AS total, dn FROM [[e]]
WHERE tier IN ('easy', 'medium', 'hard', 'impossible') AND user_id IS NOT NULL AND dn BETWEEN 19723 AND 19745 AND event_id % 97 <> 0""")

# --- joins ---
@query("""SELECT w.id, coalesce(o.fame, w.fame, 0) AS fame FROM [[w]] w LEFT JOIN (SELECT id, fame * 2 AS fame FROM [[w]] WHERE k % 3 = 0) o ON o.id = w.id""")
def join_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "w").select("id", "k", "fame")
    return tables.overlay(w.drop("k"), w.where("k % 3 = 0").select("id", (F.col("fame") * 2).alias("fame")), "id", "fame", 0.0)


sql("join_star_five", """
WITH f AS (SELECT l_orderkey, l.p AS partkey, l.s AS suppkey FROM (SELECT l_orderkey, min({struct(l_linenumber AS n, l_partkey AS p, l_suppkey AS s)|struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey)}) AS l FROM lineitem GROUP BY l_orderkey) x)
SELECT o_orderkey, o_orderstatus, p_name, s_name, n_name FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = partkey
LEFT JOIN supplier ON s_suppkey = suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")


@query("""
SELECT c.id, c.title FROM [[c]] c WHERE c.id NOT IN (SELECT id FROM [[w]]) AND (c.image = '' OR c.image NOT IN (SELECT img FROM [[w]] WHERE img IS NOT NULL))
  AND (coalesce(c.artist, '') = '' OR concat(lower(c.title), '|', c.artist) NOT IN (SELECT concat(lower(title), '|', artist) FROM [[w]] WHERE artist <> ''))""")
def join_anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = view(spark, sf_dir, "c"), view(spark, sf_dir, "w")
    pair = lambda d: F.when(~tables.blank(d["artist"]), F.concat(F.lower(d["title"]), F.lit("|"), d["artist"]))
    return tables.anti_existing(c, w.withColumnRenamed("img", "image"), [lambda d: d["id"], lambda d: d["image"], pair]).select("id", "title")


sql("join_semi_target", "SELECT id, style FROM [[w]] WHERE (style = '' OR artist = '') AND id IN (SELECT id FROM [[c]])")
# a vocabulary from the conversations: words of six letters or more that stand there twice, and
# pairs of neighbours that do so three times
SPLIT = "string_split_regex(lower(coalesce(text, '')), '[^a-z0-9à-ÿ]+')"
TERMS = f"""SELECT term FROM (SELECT w AS term FROM (SELECT unnest(list_filter({SPLIT}, lambda t: t <> '')) AS w FROM conversations) x WHERE length(w) >= 6 GROUP BY w HAVING count(*) >= 2
  UNION ALL SELECT concat(p.a, ' ', p.b) FROM (SELECT unnest(list_zip(t, t[2:])) AS z FROM (SELECT list_filter({SPLIT}, lambda t: t <> '') AS t FROM conversations) y), LATERAL (SELECT z[1] AS a, z[2] AS b) p
    WHERE p.b IS NOT NULL GROUP BY p.a, p.b HAVING count(*) >= 3) u"""
# words and pairs of neighbours of every document, and those that are terms
MENTIONS = f"""SELECT DISTINCT m.doc_id, v.term FROM (
  SELECT doc_id, unnest(t) AS term FROM (SELECT doc_id, list_filter({SPLIT}, lambda t: t <> '') AS t FROM documents) x
  UNION ALL SELECT doc_id, concat(z[1], ' ', z[2]) FROM (SELECT doc_id, unnest(list_zip(t, t[2:])) AS z FROM (SELECT doc_id, list_filter({SPLIT}, lambda t: t <> '') AS t FROM documents) y) q WHERE z[2] IS NOT NULL) m
JOIN ({TERMS}) v ON v.term = m.term"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms (term) of the conversations."""
    said = view(spark, sf_dir, "conversations").select(tokens(F.col("text")).alias("t"))
    words = said.select(F.explode("t").alias("term")).where("length(term) >= 6").groupBy("term").count().where("count >= 2")
    pairs = said.where("size(t) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.array_join(F.slice("t", i, 2), " "))).alias("term"))
    return words.select("term").unionByName(pairs.groupBy("term").count().where("count >= 3").select("term"))


@query(f"""WITH hit AS ({MENTIONS})
SELECT h.doc_id, h.term FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.term <> h.term AND (starts_with(o.term, h.term || ' ') OR ends_with(o.term, ' ' || h.term)))""")
def join_contains_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = stored(vocabulary(spark, sf_dir), "terms")
    return outermost(mentions(view(spark, sf_dir, "documents"), terms, "doc_id", "text"), terms, "doc_id")


sql("join_maker_contains", """
SELECT id, artist, place, expected, place <> expected AS mismatch FROM (SELECT w.id, w.artist, w.place, m.expected, row_number() OVER (PARTITION BY w.id ORDER BY m.ord) AS i
  FROM [[w]] w JOIN (VALUES (1, '00001', 'NATION_1'), (2, '0000', 'NATION_2')) AS m(ord, name, expected) ON contains(w.artist, m.name)) x WHERE i = 1""")
sql("join_crosswalk_id", "SELECT w.id, w.img AS old_img, coalesce('http://new/' || t.o, w.img) AS img FROM [[w]] w LEFT JOIN [[t]] t ON t.s = w.id AND t.p = 'P1071'")
# Same title and surname, at most two years apart, of an allowed kind; each work is used once.
FUZZY = """WITH hit AS (SELECT c.id, w.id AS match_id, abs(c.year - w.y) AS gap FROM ({C}) c JOIN ({W}) w ON w.f = c.f AND w.s = c.s {NEAR} WHERE w.style IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE')),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, match_id) AS i FROM hit)
SELECT id, match_id FROM (SELECT id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY gap, id) AS j FROM best WHERE i = 1) x WHERE j = 1"""


def _fuzzy(d, near: str, works: str = "[[w]]", y: str = "y") -> str:
    made = f"{text.fold_key(d, 'title')} AS f, {text.surname(d, 'artist')} AS s"
    c = f"SELECT id, {made}, year FROM [[c]] WHERE artist <> '' AND year IS NOT NULL"
    return FUZZY.replace("{C}", c).replace("{W}", f"SELECT id, {made}, style, y, {y} AS near FROM {works}").replace("{NEAR}", near)


# on Spark the years around a work are its join keys, so no pairs further apart are made
QUERIES["join_fuzzy_entity"] = lambda spark, sf_dir: spark_sql(spark, sf_dir, _fuzzy(SPARK, "AND w.near = c.year", "[[w]]", "explode(array(y - 2, y - 1, y, y + 1, y + 2))"))
ORACLES["join_fuzzy_entity"] = duck_sql(_fuzzy(DUCK, "AND abs(c.year - w.y) <= 2"))
sql("join_best_candidate", """
SELECT artist, id, links FROM (SELECT artist, id, links, row_number() OVER (PARTITION BY artist ORDER BY links DESC, id) AS i FROM [[w]] WHERE style IN ('PROMO', 'SMALL', 'LARGE') AND artist <> '') x WHERE i = 1""")
sql("join_multi_hop", """
SELECT a.s AS work, min(b.o) AS country, min(c.o) AS continent, min(l.o) AS label FROM [[t]] a JOIN [[t]] b ON b.s = a.o AND b.p = 'P27'
LEFT JOIN [[t]] c ON c.s = b.o AND c.p = 'P30' LEFT JOIN [[t]] l ON l.s = b.o AND l.p = 'label' WHERE a.p = 'P170' GROUP BY a.s""")


@query("""
WITH RECURSIVE sub AS (SELECT 't3' AS node, 0 AS depth UNION SELECT t.s, sub.depth + 1 FROM [[t]] t JOIN sub ON t.o = sub.node WHERE t.p = 'P279' AND t.s <> t.o)
SELECT concat('w', p_partkey) AS id, s.node, s.depth FROM part JOIN (SELECT node, CAST(min(depth) AS INT) AS depth FROM sub GROUP BY node) s ON s.node = concat('t', p_partkey)""")
def join_subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works whose class is, by any number of steps, a subclass of one; each class once,
    with its least depth. Only paths to that class are followed, a pointer for each node, which
    double in each round, so that their number is the depth's logarithm."""
    edges = view(spark, sf_dir, "t").where("p = 'P279'").select("s", "o")
    under = below(edges, "t3")
    reached = under.unionByName(spark.createDataFrame([("t3", 0)], "node string, depth int"))
    works = spark_sql(spark, sf_dir, "SELECT concat('w', p_partkey) AS id, concat('t', p_partkey) AS node FROM part")
    return works.join(reached, "node").select("id", "node", "depth")


sql("join_label", "SELECT a.s, a.o, coalesce(l.o, a.o) AS label FROM [[t]] a LEFT JOIN [[t]] l ON l.s = a.o AND l.p = 'label' WHERE a.p IN ('P27', 'P1071')")
sql("join_profile_board", """
SELECT b.user_id, b.points, coalesce(p.name, concat('Guest ', b.user_id % 97)) AS name FROM (SELECT user_id, CAST(sum(total) AS BIGINT) AS points FROM [[e]] WHERE tier <> 'save' GROUP BY user_id) b
LEFT JOIN (SELECT c_custkey % 150 AS device, min(c_name) AS name FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_custkey % 150) p ON p.device = b.user_id""")
sql("join_name_reserved", """
SELECT a.c_custkey, a.c_name, count(b.c_custkey) > 0 AS taken FROM customer a LEFT JOIN customer b
ON lower(b.c_name) = lower(concat('CUSTOMER#', substr(concat('00000000', CAST((a.c_custkey * 3) AS {STRING|VARCHAR})), -9))) AND b.c_nationkey <> a.c_nationkey GROUP BY a.c_custkey, a.c_name""")
# the styles of each region, from the first to the last work's year
RANGES = "SELECT concat(style, '/', region) AS name, region, min(y) AS a, max(y) AS b FROM [[w]] WHERE style <> '' AND region IS NOT NULL GROUP BY style, region"
@query(f"""
WITH m AS ({RANGES}) SELECT x.name, y.name AS other, round((least(x.b, y.b) - greatest(x.a, y.a)) / CAST(greatest(1, greatest(x.b, y.b) - least(x.a, y.a)) AS DOUBLE), 4) AS overlap
FROM m x JOIN m y ON x.region = y.region AND x.a <= y.b AND y.a <= x.b AND x.name < y.name""")
def join_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark_sql(spark, sf_dir, RANGES)
    x, y = (m.select("region", F.col("name").alias(n), F.col("a").alias(f"{s}_lo"), F.col("b").alias(f"{s}_hi")) for n, s in (("name", "a"), ("other", "b")))
    both = overlapping(x, y, ["region"], 500).where("name < other")
    shared, whole = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"), F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo")
    return both.select("name", "other", F.round(shared / F.greatest(F.lit(1), whole).cast("double"), 4).alias("overlap"))


sql("join_erase_keys", """
WITH gone AS (SELECT DISTINCT c_custkey % 150 AS device FROM customer WHERE c_nationkey = 7)
SELECT 'scores' AS tbl, count(*) AS n FROM [[e]] e WHERE tier <> 'save' AND user_id NOT IN (SELECT device FROM gone) UNION ALL
SELECT 'saves', count(*) FROM [[e]] e WHERE tier = 'save' AND user_id NOT IN (SELECT device FROM gone) UNION ALL
SELECT 'profiles', count(*) FROM customer WHERE c_custkey % 150 NOT IN (SELECT device FROM gone)""")
sql("join_cue_cascade", """
WITH cue AS (SELECT * FROM (VALUES ('style', 'PROMO', 'flat colour'), ('style', 'SMALL', 'fine detail'), ('region', 'ASIA', 'ink and brush'), ('region', 'AFRICA', 'carved form'), ('medium', 'odd', 'grain')) AS v(kind, k, txt))
SELECT w.id, concat_ws('; ', coalesce(s.txt, r.txt), m.txt) AS cue FROM [[w]] w LEFT JOIN cue s ON s.kind = 'style' AND s.k = w.style LEFT JOIN cue r ON r.kind = 'region' AND r.k = w.region
LEFT JOIN cue m ON m.kind = 'medium' AND w.k % 2 = 1""")

# --- deduplication ---
PAIR = "CASE WHEN artist <> '' THEN concat(lower(title), '|', lower(artist)) END"


@query(f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY coalesce(x, concat('~', id)) ORDER BY src_priority, id) AS i FROM (SELECT *, {PAIR} AS x FROM [[c]]) p),
b AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN image = '' THEN concat('~', id) ELSE image END ORDER BY src_priority, id) AS j FROM a WHERE i = 1)
SELECT id, src_priority FROM b WHERE j = 1""")
def dedup_first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("src_priority"), F.asc("id")]
    return tables.dedup_passes(view(spark, sf_dir, "c"), [F.expr(PAIR), F.col("image")], order).select("id", "src_priority")


@query("""
WITH s AS (SELECT *, links * 10 + CASE WHEN artist <> '' THEN 5 ELSE 0 END + CASE WHEN style <> '' THEN 3 ELSE 0 END AS score, k % 900 AS ent FROM [[w]]),
a AS (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY score DESC NULLS LAST, id) AS i FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC NULLS LAST, id) AS j FROM a WHERE i = 1) SELECT id, score FROM b WHERE j = 1""")
def dedup_best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.when(F.col("artist") != "", 5).otherwise(0) + F.when(F.col("style") != "", 3).otherwise(0)
    scored = view(spark, sf_dir, "w").withColumn("score", F.col("links") * 10 + filled)
    return tables.dedup_passes(scored, [F.col("k") % 900, F.col("img")], [F.desc_nulls_last("score"), F.asc("id")]).select("id", "score")


sql("dedup_max_by_key", "SELECT title, max_by(id, struct(fame_hint, id)) AS id, max(fame_hint) AS score FROM [[c]] WHERE fame_hint IS NOT NULL GROUP BY title",
    oracle="SELECT title, id, fame_hint AS score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY fame_hint DESC, id DESC) AS i FROM [[c]] WHERE fame_hint IS NOT NULL) x WHERE i = 1")
sql("dedup_flag_repeats", "SELECT id, row_number() OVER (PARTITION BY lower(title), lower(artist) ORDER BY k) > 1 AS repeated FROM [[w]]")
sql_pair("dedup_shared_key_groups", lambda d: f"SELECT key, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {d.ext(text.image_key(d, 'url'), '[^/]+$')} AS key FROM pages) x GROUP BY key HAVING count(*) > 1")
sql("dedup_queue_append", """
SELECT id, kind, gen FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY gen, ord) AS i FROM (
  SELECT id, 'thin' AS kind, 0 AS gen, k AS ord FROM [[w]] WHERE k % 4 = 0 UNION ALL SELECT id, 'thin', 1, k FROM [[w]] WHERE k % 6 = 0 UNION ALL SELECT id, 'place', 1, k FROM [[w]] WHERE k % 9 = 0) q) x WHERE i = 1""")
sql("dedup_nested_points", """
SELECT id, n, n_places FROM (SELECT id, count(*) AS n, count(DISTINCT concat(floor(px), ',', floor(py))) AS n_places FROM (
  SELECT id, ((k * x.i * 37) % 100) / 7 AS px, ((k * x.i * 11) % 100) / 9 AS py FROM [[w]], (VALUES (1), (2), (3), (4)) AS x(i)) p GROUP BY id) y WHERE n_places < n""")


@query("""
WITH RECURSIVE tok AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM [[g]]) x WHERE w <> '' AND w NOT IN (STOPWORDS)),
n AS (SELECT conv_id, turn, count(*) AS n FROM tok GROUP BY conv_id, turn),
link AS (SELECT a.conv_id, a.turn AS a, b.turn AS b FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn <> b.turn
  JOIN n x ON x.conv_id = a.conv_id AND x.turn = a.turn JOIN n y ON y.conv_id = b.conv_id AND y.turn = b.turn
  GROUP BY a.conv_id, a.turn, b.turn, x.n, y.n HAVING count(*) >= 0.6 * (x.n + y.n - count(*))),
reach AS (SELECT conv_id, turn, turn AS root FROM [[g]] UNION SELECT l.conv_id, l.b, r.root FROM reach r JOIN link l ON l.conv_id = r.conv_id AND l.a = r.turn),
c AS (SELECT conv_id, turn, min(root) AS cluster FROM reach GROUP BY conv_id, turn),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id, c.cluster ORDER BY length(g.a) DESC, c.turn) AS i FROM c JOIN [[g]] g ON g.conv_id = c.conv_id AND g.turn = c.turn)
SELECT conv_id, turn, cluster, i = 1 AS kept FROM r""".replace("STOPWORDS", ", ".join(f"'{s}'" for s in rules.STOP)))
def dedup_jaccard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one conversation whose words, stop words left out, have a Jaccard
    similarity of 0.6 or more are linked; of each cluster the longest answer stays."""
    g = view(spark, sf_dir, "g")
    words = F.array_except(F.split(F.regexp_replace(F.lower("q"), "[^a-z0-9]+", " "), " "), F.array(*map(F.lit, ["", *rules.STOP])))
    said = g.select("conv_id", "turn", words.alias("words"))
    a = said.select("conv_id", "turn", F.size("words").alias("n"), F.explode("words").alias("w"))
    x, y = (a.select("conv_id", "w", F.col("turn").alias(t), F.col("n").alias(n)) for t, n in (("x", "nx"), ("y", "ny")))
    shared = x.join(y, ["conv_id", "w"]).where("x < y").groupBy("conv_id", "x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("both"))
    links = shared.where("both >= 0.6 * (nx + ny - both)")
    node = lambda t: F.struct("conv_id", F.col(t).alias("turn"))
    found = clusters(g.select(node("turn").alias("node")), links.select(node("x").alias("a"), node("y").alias("b")))
    labels = found.select("node.conv_id", "node.turn", F.col("cluster.turn").alias("cluster"))
    best = Window.partitionBy("conv_id", "cluster").orderBy(F.desc("length"), "turn")
    lengths = g.select("conv_id", "turn", F.length("a").alias("length"))
    return labels.join(lengths, ["conv_id", "turn"]).withColumn("kept", F.row_number().over(best) == 1).drop("length")
