"""Quality gates, enrichment and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atelier.functions import text
from atelier.functions.dialect import DUCK, SPARK
from atelier.operators import tables
from atelier.operators.vocabulary import marked, mentions, stored
from atelier.plans.makers import Makings, made_at, number
from atelier.queries.base import query, spark_sql, sql, view

from atelier.queries.joins import MENTIONS, TERMS, vocabulary
from atelier.queries.scalars import MEDIA, formed, sql_pair

RULES = [
    ("hard", "no_region", "region IS NULL"), ("warn", "no_artist", "artist = ''"), ("warn", "no_style", "style = ''"),
    ("warn", "small_image", "p_size < 5"), ("hard", "no_title", "title = ''"), ("warn", "future", "y > 2020"),
]
LONG = " UNION ALL ".join(f"SELECT id, '{level}' AS level, '{name}' AS rule FROM [[w]] WHERE {bad}" for level, name, bad in RULES)


@query(LONG)
def dq_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.violations(view(spark, sf_dir, "w"), "id", [(a, b, F.expr(c)) for a, b, c in RULES])


@query(f"""SELECT rule, level, n, string_agg(id, ',' ORDER BY id) AS samples FROM (
  SELECT *, count(*) OVER (PARTITION BY rule, level) AS n, row_number() OVER (PARTITION BY rule, level ORDER BY id) AS i FROM ({LONG}) l) x WHERE i <= 4 GROUP BY rule, level, n""")
def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's report: how often each rule fails, with its first four works. Counts are
    partial sums; of a rule each task passes on its four least (a group limit), no more."""
    found = dq_row_rules(spark, sf_dir)
    counts = found.groupBy("rule", "level").agg(F.count(F.lit(1)).alias("n"))
    least = found.withColumn("i", F.row_number().over(Window.partitionBy("rule", "level").orderBy("id"))).where("i <= 4")
    samples = least.groupBy("rule", "level").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return counts.join(samples, ["rule", "level"])


sql("dq_missing_fields", "SELECT id, concat_ws(',', CASE WHEN artist = '' THEN 'artist' END, CASE WHEN style = '' THEN 'style' END, CASE WHEN region IS NULL THEN 'region' END) AS missing FROM [[w]] WHERE artist = '' OR style = '' OR region IS NULL")
sql_pair("dq_copy_integrity", lambda d: f"""
SELECT doc_id, NOT {d.match('trim(text)', '[.!?]$')} AS cut_off, {d.match('text', '^[a-z]')} AS headless, {d.match('lower(trim(text))', ' (the|of|and|to|a)[.]?$')} AS dangling FROM documents""")
sql("dq_pin_coverage", "SELECT id FROM [[w]] WHERE k % 3 <> 0 AND style NOT IN ('PROMO') AND id NOT IN (SELECT id FROM [[w]] WHERE k % 4 = 0) AND id NOT IN (SELECT id FROM [[w]] WHERE k % 10 = 7)")
# the text about a work, with the centuries that its note claims
NOTES = f"""SELECT w.id, w.y, concat(substr(d.text, 1, 400), ' Made in the ', CAST({{c}} + w.k % 3 - 1 AS {{STRING|VARCHAR}}), 'th', CASE WHEN w.k % 2 = 0 THEN ' ' ELSE '-' END, 'century',
  CASE WHEN w.k % 5 = 0 THEN concat(', unlike works of the ', CAST({{c}} + w.k % 2 AS {{STRING|VARCHAR}}), 'TH Century.') ELSE '.' END) AS note FROM [[w]] w JOIN documents d ON d.doc_id = w.k WHERE w.y > 0"""
CLAIM = r"(?i)\b([0-9][0-9]?)(?:st|nd|rd|th)[- ]century\b"


@query(f"""
SELECT id, y, c, claimed FROM (SELECT id, y, {text.century(DUCK, 'y')} AS c, list_sort(list_distinct(list_transform(regexp_extract_all(note, '{CLAIM}', 1), lambda x: CAST(x AS INT)))) AS claimed FROM ({NOTES.replace('{c}', text.century(DUCK, 'w.y'))}) n) x
WHERE NOT list_contains(claimed, c) AND (list_contains(claimed, c - 1) OR list_contains(claimed, c + 1))""")
def dq_century_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose text claims centuries, none of them the true one, but one next to it."""
    notes = spark_sql(spark, sf_dir, NOTES.replace("{c}", text.century(SPARK, "w.y")))
    claims = F.transform(F.regexp_extract_all("note", F.lit(CLAIM), F.lit(1)), lambda x: x.cast("int"))
    found = notes.select("id", "y", F.expr(text.century(SPARK, "y")).alias("c"), F.array_sort(F.array_distinct(claims)).alias("claimed"))
    off = F.exists("claimed", lambda x: F.abs(x - F.col("c")) == 1)
    return found.where(off & ~F.array_contains("claimed", F.col("c")))


# a style's names are terms of the conversations, dealt to the styles by their digest; names that
# a fifth of the documents mention are ambiguous
NAMED = f"""SELECT v.term, s.style FROM ({TERMS}) v JOIN (SELECT style, row_number() OVER (ORDER BY style) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT style FROM [[w]] WHERE style <> '') x) s
  ON s.i = CAST(concat('0x', substr(md5(v.term), 1, 6)) AS BIGINT) % s.n"""


def styles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the few styles, in order."""
    return spark_sql(spark, sf_dir, "SELECT array_sort(collect_set(style)) AS styles FROM [[w]] WHERE style <> ''")


def named_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, style and at (the style's place among all): what each style is called in texts."""
    number = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 6), 16, 10).cast("long")
    named = vocabulary(spark, sf_dir).crossJoin(F.broadcast(styles_of(spark, sf_dir))).where("size(styles) > 0")
    at = (number % F.size("styles")).cast("int")
    return stored(named.select("term", F.get("styles", at).alias("style"), at.alias("at")), "styles")


def articles(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """id, style and the text about it, null where there is none, of works."""
    works = view(spark, sf_dir, "w").where(where).select("id", "k", "style")
    return works.join(view(spark, sf_dir, "documents").select("doc_id", "text"), F.col("k") == F.col("doc_id"), "left").select("id", "style", "doc_id", "text")


@query(f"""
WITH m AS ({MENTIONS}), often AS (SELECT term FROM m GROUP BY term HAVING count(*) * 5 > (SELECT count(*) FROM documents))
SELECT id, term, style FROM (SELECT w.id, n.term, n.style, row_number() OVER (PARTITION BY w.id ORDER BY length(n.term) DESC, n.term) AS i
  FROM [[w]] w JOIN m ON m.doc_id = w.k JOIN ({NAMED}) n ON n.term = m.term WHERE w.style = '' AND n.term NOT IN (SELECT term FROM often)) x WHERE i = 1""")
def dq_style_from_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works without a style whose text names one: by the longest name that is not ambiguous."""
    terms, docs = named_styles(spark, sf_dir), view(spark, sf_dir, "documents").select("doc_id", "text")
    # a key counts once for a term: of keys that several texts share, each is told apart
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1").select(hashed.alias("h")), "repeated")
    found = mentions(docs, terms, "doc_id", "text").withColumn("twice", marked(repeated, hashed))
    keys = F.count_if(~F.col("twice")) + F.count_distinct(F.when(F.col("twice"), F.struct("doc_id")))
    often = found.groupBy("term").agg(keys.alias("count")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("docs")))).where("count * 5 > docs")
    often = stored(often.select("term"), "often")
    blank = stored(view(spark, sf_dir, "w").where("style = ''").select("id", F.col("k").alias("doc_id")), "blank")
    texts = blank.join(docs.where(marked(blank.select(hashed.alias("h")), hashed)), "doc_id")
    named = mentions(texts, terms, "id", "text").join(often, "term", "left_anti").join(terms, "term")
    best = named.groupBy("id").agg(F.min(F.struct((-F.length("term")).alias("n"), "term", "style")).alias("b"))
    return best.select("id", "b.term", "b.style")


sql_pair("dq_thin_rows", lambda d: f"SELECT id FROM (SELECT id, style, {text.medium_bucket(d, formed(d, MEDIA, 'title'))} AS medium FROM [[w]]) x WHERE style = '' AND medium = ''")
sql("dq_field_provenance", """
SELECT w.id, w.artist, count(s.s_name) > 0 AS supported FROM [[w]] w LEFT JOIN [[t]] t ON t.s = w.id AND t.p = 'P170'
LEFT JOIN supplier s ON concat('m', s.s_suppkey) = t.o AND s.s_name = w.artist WHERE w.artist <> '' GROUP BY w.id, w.artist""")
@query("""
WITH b AS (SELECT a.s, min(x.o) AS birth, min(z.o) AS work_place FROM [[t]] a LEFT JOIN [[t]] x ON x.s = a.o AND x.p = 'P19' LEFT JOIN [[t]] z ON z.s = a.o AND z.p = 'P937' WHERE a.p = 'P170' GROUP BY a.s)
SELECT s, CASE WHEN m.o = birth AND work_place <> birth THEN 'HIGH' WHEN m.o <> work_place THEN 'MED' ELSE 'OK' END AS level FROM b JOIN (SELECT s AS ms, o FROM [[t]] WHERE p = 'P1071') m ON m.ms = s""")
def dq_place_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maker's first birthplace and first place of work are found once, not for each work."""
    facts = spark_sql(spark, sf_dir, f"SELECT {number()} AS m, min(CASE WHEN p = 'P19' THEN o END) AS birth, min(CASE WHEN p = 'P937' THEN o END) AS work_place FROM [[t]] WHERE p IN ('P19', 'P937') GROUP BY s")
    places = made_at(spark, sf_dir)
    found = Makings(spark, sf_dir, places).known(facts).groupBy("k").agg(F.min("birth").alias("birth"), F.min("work_place").alias("work_place"))
    level = F.when((F.col("o") == F.col("birth")) & (F.col("work_place") != F.col("birth")), "HIGH").when(F.col("o") != F.col("work_place"), "MED").otherwise("OK")
    return places.join(found, "k").select("s", level.alias("level"))


@query(f"""
WITH m AS ({MENTIONS}), n AS ({NAMED}), v AS (SELECT m.doc_id, n.style FROM m JOIN n ON n.term = m.term GROUP BY m.doc_id, n.style),
x AS (SELECT w.id, w.style, d.doc_id, count(v.style) AS styles, count(CASE WHEN v.style = w.style THEN 1 END) AS own FROM [[w]] w LEFT JOIN documents d ON d.doc_id = w.k LEFT JOIN v ON v.doc_id = d.doc_id WHERE w.style <> '' GROUP BY w.id, w.style, d.doc_id)
SELECT style, verdict, count(*) AS n FROM (SELECT style, CASE WHEN doc_id IS NULL THEN 'no article' WHEN own > 0 THEN 'match' WHEN styles > 0 THEN 'mismatch' ELSE 'no mention' END AS verdict FROM x) y GROUP BY style, verdict""")
def dq_style_vs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the text about a work call it by a name of its style, of others only, or of none?"""
    terms, works = named_styles(spark, sf_dir), articles(spark, sf_dir, "style <> ''").select("id", "style", "doc_id")
    # of a text's styles only their bits are sent, 64 in a long
    found = mentions(view(spark, sf_dir, "documents"), terms, "doc_id", "text").join(terms, "term")
    found = found.groupBy("doc_id", F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
    own = works.crossJoin(F.broadcast(styles_of(spark, sf_dir))).select("id", "style", "doc_id", (F.array_position("styles", F.col("style")) - 1).cast("int").alias("own"))
    here = (F.col("cell") == F.shiftright("own", 6)) & (F.getbit("bits", F.col("own").bitwiseAND(F.lit(63))) == 1)
    each = own.join(found, "doc_id", "left").groupBy("id", "style", "doc_id").agg(F.max(here).alias("match"), F.count("cell").alias("n"))
    verdict = F.when(F.col("doc_id").isNull(), "no article").when(F.col("match"), "match").when(F.col("n") > 0, "mismatch").otherwise("no mention")
    return each.groupBy("style", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


sql("dq_popularity_flags", """
SELECT id, 'anonymous in top' AS flag FROM [[w]] WHERE artist = '' AND fame >= 440 UNION ALL SELECT id, 'few links' FROM [[w]] WHERE links < 20 AND fame >= 430
UNION ALL SELECT must.title, 'missing' FROM (SELECT DISTINCT title FROM [[c]] WHERE k % 9 = 0) must WHERE NOT EXISTS (SELECT 1 FROM [[w]] w WHERE w.title = must.title)""")
sql("dq_death_after", """
SELECT w.src, w.artist, count(*) AS n FROM (SELECT DISTINCT a.s FROM [[t]] a JOIN [[t]] d ON d.s = a.o AND d.p = 'P570' AND CAST(d.o AS INT) > 1990 WHERE a.p = 'P170') x JOIN [[w]] w ON w.id = x.s GROUP BY w.src, w.artist""")
sql("dq_aspect_ratio", """
SELECT id, CASE WHEN h = 0 THEN 'broken' WHEN CAST(wd AS DOUBLE) / h >= 3.2 THEN 'wide' WHEN CAST(h AS DOUBLE) / wd >= 3.2 THEN 'tall' ELSE 'ok' END AS shape FROM (SELECT id, p_size * 10 AS wd, (k % 50) * 7 AS h FROM [[w]]) x""")
sql("dq_status_triage", """
SELECT k, CASE max_by(tier, struct(ts, event_id)) WHEN 'impossible' THEN 'broken' WHEN 'save' THEN 'unknown' ELSE 'ok' END AS status, count(*) AS checks FROM [[e]] GROUP BY k""",
    oracle="SELECT k, CASE tier WHEN 'impossible' THEN 'broken' WHEN 'save' THEN 'unknown' ELSE 'ok' END AS status, n AS checks FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS i FROM [[e]]) x WHERE i = 1")
sql("dq_notes_valid", """
SELECT conv_id, count(*) AS n_pairs, min(length(q)) AS shortest, count(*) >= 2 AND min(length(q)) >= 40 AND max(length(a)) < 4000 AS valid FROM [[g]] GROUP BY conv_id""")

# --- enrichment ---
@query("""
SELECT w.id, coalesce(nullif(w.artist, ''), concat('maker ', w.k % 10)) AS artist, coalesce(nullif(w.style, ''), CASE WHEN w.k % 2 = 0 THEN 'folk' END) AS style FROM [[w]] w""")
def enr_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "w").select("id", "k", "artist", "style")
    source = w.select("id", F.concat(F.lit("maker "), (F.col("k") % 10).cast("string")).alias("artist"), F.when(F.col("k") % 2 == 0, "folk").alias("style"))
    return tables.fill_missing(w.drop("k"), source, "id", ["artist", "style"])


sql("enr_remeasure", """
SELECT w.id, CASE WHEN w.views IS NULL OR w.views < 28 THEN coalesce(m.total, w.views) ELSE w.views END AS views, w.views IS NULL OR w.views < 28 AS remeasured
FROM [[w]] w LEFT JOIN (SELECT k, max(total) AS total FROM [[e]] GROUP BY k) m ON m.k = w.k""")
sql("enr_priority_source", """
SELECT w.id, coalesce(a.o, b.o, 'none') AS origin, CASE WHEN a.o IS NOT NULL THEN 'made-at' WHEN b.o IS NOT NULL THEN 'maker' ELSE 'none' END AS source FROM [[w]] w
LEFT JOIN [[t]] a ON a.s = w.id AND a.p = 'P1071' LEFT JOIN (SELECT x.s, min(y.o) AS o FROM [[t]] x JOIN [[t]] y ON y.s = x.o AND y.p = 'P27' WHERE x.p = 'P170' GROUP BY x.s) b ON b.s = w.id""")
sql("enr_override_apply", "SELECT w.id, coalesce(o.place, w.place) AS place, o.place IS NOT NULL AND o.place <> w.place AS changed FROM [[w]] w LEFT JOIN (SELECT id, 'NATION_9' AS place FROM [[w]] WHERE k % 5 = 0) o ON o.id = w.id")
# where makers are from, by surname, and years that are known, as tables
ORIGINS = "SELECT CAST(s_suppkey AS {STRING|VARCHAR}) AS surname, n_name AS place, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 3 <> 0"
YEARS_KNOWN = "SELECT p_name AS title, min(1400 + p_size * 10) AS year FROM part WHERE p_partkey % 4 = 0 GROUP BY p_name"
sql_pair("enr_maker_defaults", lambda d: f"""
WITH w AS (SELECT id, title, CASE WHEN artist = '' THEN NULL ELSE concat('Painter of ', artist) END AS artist, CASE WHEN k % 6 = 0 THEN NULL ELSE y END AS y, place, region FROM [[w]])
SELECT w.id, coalesce(w.y, k.year) AS y, coalesce(o.place, w.place) AS place, coalesce(o.region, w.region) AS region FROM w LEFT JOIN ({YEARS_KNOWN}) k ON k.title = w.title
LEFT JOIN ({ORIGINS}) o ON o.surname = {d.sub("lower(" + d.last('w.artist', '[ #]') + ")", '^0+')} WHERE coalesce(w.y, k.year) IS NOT NULL""")
@query("""
WITH wk AS (SELECT a.s, z.o, count(*) AS c FROM [[t]] a JOIN [[t]] z ON z.s = a.o AND z.p = 'P937' WHERE a.p = 'P170' GROUP BY a.s, z.o),
top AS (SELECT s, o FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, o) AS i FROM wk) x WHERE i = 1)
SELECT m.s, m.o AS now, top.o AS proposed FROM [[t]] m JOIN top ON top.s = m.s WHERE m.p = 'P1071' AND NOT EXISTS (SELECT 1 FROM wk WHERE wk.s = m.s AND wk.o = m.o)
  AND NOT EXISTS (SELECT 1 FROM [[t]] a JOIN [[t]] c ON c.s = a.o AND c.p = 'P27' WHERE a.s = m.s AND a.p = 'P170' AND c.o = m.o)""")
def geo_footprint_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of work count, lands of citizenship only bar a change; a maker has both as one
    short array, and a work's makers are added up by place in the task that has the work."""
    facts = spark_sql(spark, sf_dir, f"SELECT m, collect_list(struct(o, n)) AS places FROM (SELECT {number()} AS m, o, count(CASE WHEN p = 'P937' THEN 1 END) AS n FROM [[t]] WHERE p IN ('P937', 'P27') GROUP BY s, o) x GROUP BY m")
    places = made_at(spark, sf_dir)
    near = Makings(spark, sf_dir, places).distinct().known(facts).select("k", F.explode("places").alias("z"))
    counts = near.groupBy("k", F.col("z.o").alias("p")).agg(F.sum("z.n").alias("c"))
    top = F.min(F.when(F.col("c") > 0, F.struct((-F.col("c")).alias("c"), "p")))
    found = counts.groupBy("k").agg(F.collect_set("p").alias("near"), top.alias("top"))
    other = ~F.coalesce(F.array_contains("near", F.col("o")), F.lit(False))
    return places.join(found, "k").where(F.col("top").isNotNull() & other).select("s", F.col("o").alias("now"), F.col("top.p").alias("proposed"))


# --- merging ---
@query("SELECT id, title FROM [[w]] WHERE id NOT IN (SELECT id FROM [[c]]) UNION ALL SELECT id, title FROM [[c]]")
def mrg_upsert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(view(spark, sf_dir, "w").select("id", "title"), view(spark, sf_dir, "c").select("id", "title"), "id")


sql("mrg_promote", """
SELECT c.id, c.title, coalesce(c.artist, '') AS artist, c.year AS y, 'harvest' AS origin FROM [[c]] c WHERE c.year IS NOT NULL AND c.image <> '' AND c.id NOT IN (SELECT id FROM [[w]])
UNION ALL SELECT id, title, artist, y, 'pool' FROM [[w]]""")
sql("mrg_ready_split", "SELECT id, fame_hint, CASE WHEN place IS NULL THEN 'needs origin' ELSE 'ready' END AS state FROM [[c]] WHERE fame_hint IS NOT NULL ORDER BY fame_hint DESC, id LIMIT 200")
sql("mrg_stage_or_park", """
SELECT c.id, CASE WHEN c.fame_hint >= x.cutoff THEN 'staged' ELSE 'parked' END AS state FROM [[c]] c JOIN (VALUES (0, 430.0), (1, 420.0), (2, 410.0), (3, 400.0), (4, 440.0)) AS x(p, cutoff) ON x.p = c.src_priority
WHERE c.fame_hint IS NOT NULL AND NOT (c.fame_hint < x.cutoff AND c.k % 8 = 0)""")
sql("mrg_guarded_changes", """
WITH ch AS (SELECT id, 'style' AS field, CASE WHEN k % 2 = 0 THEN 'PROMO' ELSE 'Strange' END AS value FROM [[w]] WHERE k % 3 = 0 UNION ALL SELECT id, 'place', 'NATION_2' FROM [[w]] WHERE k % 7 = 0)
SELECT id, field, value, CASE WHEN field = 'style' AND value IN (SELECT DISTINCT style FROM [[w]]) THEN 'applied' ELSE 'queued' END AS state FROM ch""")
sql_pair("mrg_mechanical_review", lambda d: f"""
SELECT id, title, new_title, {text.fold_key(d, 'title')} = {text.fold_key(d, 'new_title')} AS mechanical FROM (SELECT w.id, w.title, c.title AS new_title FROM [[w]] w JOIN [[c]] c ON c.k = w.k WHERE c.title <> w.title) x""")
sql("mrg_rekey", "SELECT e.event_id, coalesce(m.new_id, concat('w', e.k)) AS work FROM [[e]] e LEFT JOIN (SELECT id, concat('n', k) AS new_id FROM [[w]] WHERE k % 5 = 0) m ON m.id = concat('w', e.k)")


@query("SELECT user_id, max(total) AS best, max(dn) AS last_day, count(DISTINCT dn) AS days, CAST(coalesce(max(total) FILTER (dn = 19725), 0) AS BIGINT) AS on_day FROM [[e]] WHERE tier <> 'save' GROUP BY user_id")
def mrg_streak_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of each user, one a half of the month, merged: larger counters, later
    dates, all days, the best score of each day."""
    half = """SELECT user_id, max(best) AS best, max(dn) AS last_day, array_sort(collect_list(dn)) AS days, map_from_entries(collect_list(struct(dn, best))) AS scores
      FROM (SELECT user_id, dn, max(total) AS best FROM [[e]] WHERE tier <> 'save' AND {} GROUP BY user_id, dn) x GROUP BY user_id"""
    a, b = (spark_sql(spark, sf_dir, half.replace("{}", c)).select("user_id", *[F.col(n).alias(f"{n}_{s}") for n in ("best", "last_day", "days", "scores")]) for s, c in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1")))
    both = a.join(b, "user_id", "full")
    empty_map, empty = F.expr("cast(map() as map<bigint,bigint>)"), F.expr("cast(array() as array<bigint>)")
    scores = F.map_zip_with(F.coalesce("scores_a", empty_map), F.coalesce("scores_b", empty_map), lambda k, x, y: F.greatest(x, y))
    days = F.array_union(F.coalesce("days_a", empty), F.coalesce("days_b", empty))
    return both.select(
        "user_id", F.greatest("best_a", "best_b").alias("best"), F.greatest("last_day_a", "last_day_b").alias("last_day"), F.size(days).cast("long").alias("days"),
        F.coalesce(F.try_element_at(scores, F.lit(19725).cast("long")), F.lit(0)).alias("on_day"),
    )


sql("mrg_identity_pick", """
SELECT c_nationkey AS account, min_by(c_name, struct(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END, c_custkey)) AS name, count(*) AS devices FROM customer GROUP BY c_nationkey""",
    oracle="SELECT c_nationkey AS account, c_name AS name, n AS devices FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END, c_custkey) AS i FROM customer) x WHERE i = 1")


@query("SELECT conv_id, count(*) AS n_notes, CAST(sum(length(q)) AS BIGINT) AS head_chars FROM [[g]] GROUP BY conv_id")
def mrg_notes_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs as one array of notes for each guide, in order."""
    notes = view(spark, sf_dir, "g").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("q").alias("head"), F.col("a").alias("body")))).alias("notes"))
    chars = F.aggregate("notes", F.lit(0).cast("long"), lambda s, n: s + F.length(n["head"]))
    return notes.select("conv_id", F.size("notes").cast("long").alias("n_notes"), chars.alias("head_chars"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pin, (turn * 13 + conv_id) % 100 AS x FROM [[g]]")
def mrg_pins_into_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, by the note's index, set as x inside the nested notes; then listed."""
    g = view(spark, sf_dir, "g").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    pinned = g.withColumn("notes", F.transform("turns", lambda t, i: F.struct(t.alias("turn"), ((t * 13 + F.col("conv_id")) % 100).alias("x"))))
    return pinned.select("conv_id", F.posexplode("notes").alias("pin", "n")).select("conv_id", "n.turn", F.col("pin").cast("long").alias("pin"), "n.x")

# Supports, and the paints that win over them, in order of preference.
SUPPORTS = ("wood", "canvas", "panel", "paper")
PAINTS = ("oil paint", "tempera", "watercolor", "ink")


@query(f"""
WITH m AS (SELECT s, o, CASE o {" ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PAINTS))} END AS rank FROM [[t]] WHERE p = 'P186')
SELECT s AS id, max(CASE WHEN o IN ('wood', 'canvas', 'panel', 'paper') THEN o END) AS medium, coalesce(min_by(o, rank), 'wood') AS fixed FROM m GROUP BY s""")
def fn_medium_support_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the medium is a support, the preferred paint among the work's materials."""
    materials = view(spark, sf_dir, "t").where("p = 'P186'").groupBy(F.col("s").alias("id")).agg(F.collect_set("o").alias("all"))
    support = F.get(F.filter("all", lambda m: m.isin(*SUPPORTS)), F.lit(0))
    order = F.array(*map(F.lit, PAINTS))
    paint = F.get(F.filter(order, lambda p: F.array_contains("all", p)), F.lit(0))
    return materials.select("id", support.alias("medium"), F.coalesce(paint, support).alias("fixed"))
