"""Scalar functions over the catalogue: each query reads a column, as it stands or in forms in
which such texts are found, and applies one function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.functions import rules, text
from atelier.functions.dialect import DUCK, SPARK, Dialect
from atelier.operators.intervals import within
from atelier.operators.vocabulary import mentions
from atelier.plans.views import duck_sql
from atelier.queries.base import ORACLES, QUERIES, spark_sql

# Forms in which a text stands; @ is a column of the row.
MEDIA = [
    "Oil on panel", "oil on @", "Tempera on wood", "Gelatin silver print of a @", "Silver @", "Copper", "Engraving on copperplate, after a @", "Bronze", "Wood and @",
    "Carved olive pit", "Albumen silver print from glass negative", "Fritware, underglaze-painted, @", "Fritware, polychrome underglaze painted",
    "Quartzite", "Greywacke @", "Granodiorite", "Travertine (tecali)", "Ink and gold on @ paper", "Leather", "leather @", "Wax", "wax", "egyptian blue",
    "@", "unclassified material, @", "verbose unclassified @ record", "Carving", "carved", "Carved ivory @", "", "—",
    "mixed media on paper", "mixed-media collage", "assemblage of found plastic and @",
]
MAKERS = ["@ (吳)", "@ 葛飾北斎", "@", " @  the  elder ", "Studio of @", "Attributed to @", "Unknown", "@ (1853-1890)\nDutch", "Anonymous", "Édouard @"]
STYLES = ["@", "french", "late @", "Qing dynasty (1644-1911), @", "Late 18th century", "Dutch to @", "@ painting", "@ Art", "@, 1200-1300", "A very long style label, with @, and more parts"]
PLACES = ["@", "@ (Town)", "@/North", "Port, @", "Kingdom of @", "@, Harbour, Upper Quarter", "a @ painter", "Far Isles, @ (Bay)", "Nowhere"]
YEARS = ["early 5th century B.C.", "late 18th century", "@s", "ca. @-1655", "3rd century", "@ BCE", "undated", "1884/86", "c. @", "-@", "1890-1880", "+@-06-01T00:00:00Z", "-@-01-01T00:00:00Z"]
SIZES = ["12.5 x @ cm", "@ × 200 mm", "10 x @ in", "no size", "@ x 2 m", "20 x @"]
TITLES = ["The @ (print)", "@, 1923", "Mount @, from the series Views", "1982.60.@", "AB12.@", "Portrait of a @"]
URLS = ["@", "https://iiif.example.org/@/full/!400,400/0/default.jpg", "File:@.jpg"]
ERAS = [(-99999, 0, "Before 1 CE"), (1, 499, "Antiquity"), (500, 1399, "Middle ages"), (1400, 1799, "Early modern"), (1800, 9999, "Modern")]


def over(name: str, source: str | list[str], build, column: str = "title") -> None:
    """Register a query of id, the input and the function's result; source names a column of
    works, or gives forms that stand in turn round the given column."""

    def body(d: Dialect) -> str:
        x = source if isinstance(source, str) else formed(d, source, column)
        return f"SELECT id, x, {build(d, 'x')} AS out FROM (SELECT id, k, {x} AS x FROM [[w]]) q"

    QUERIES[name] = lambda spark, sf_dir: spark_sql(spark, sf_dir, body(SPARK))
    ORACLES[name] = duck_sql(body(DUCK))


def formed(d: Dialect, forms: list[str], column: str) -> str:
    """The forms in turn, each round the column's text."""
    return f"replace({d.pick(forms, 'k')}, '@', coalesce(CAST({column} AS {'VARCHAR' if d.duck else 'STRING'}), ''))"


over("fn_medium_bucket", MEDIA, text.medium_bucket)
over("fn_medium_fallback", MEDIA[20:26] + ["papier-mâché and @", "a very long @ material text without any commas at all"], text.medium_fallback)
over("fn_medium_family", MEDIA, lambda d, x: text.medium_family(d, text.medium_bucket(d, x)))
over("fn_artist_clean_display", MAKERS, text.artist_display, "artist")
over("fn_artist_base", MAKERS, text.artist_base, "artist")
over("fn_surname", ["Vincent van @", "@", "Mary @ ", "J. M. W. @"], text.surname, "style")
over("fn_style_clean", STYLES, text.style_clean, "style")
over("fn_movement_suffix", STYLES, text.movement_suffix, "style")
over("fn_style_fold_key", ["Art @", "art-@", "ART @", "Édo @", "edo @"], text.fold_key, "style")
over("fn_continent_latlng", "k", lambda d, x: text.continent_at(d, f"(({x} * 37) % 180 - 90)", f"(({x} * 53) % 360 - 180)"))
over("fn_deaccent", ["Édouard @", "Frédéric @", "Müller @", "@"], text.deaccent, "artist")
over("fn_entity_id", ["wikidata:Q@", "http://x.org/entity/Q@", "met@", "Q@"], text.entity_id, "k")
over("fn_title_search_key", TITLES, text.title_key)
over("fn_url_filepath", URLS, text.file_path, "img")
over("fn_year_midpoint", "y", lambda d, x: text.year_midpoint(d, x, f"CASE WHEN {x} % 5 = 0 THEN NULL ELSE {x} + 25 END"))
over("fn_year_text", YEARS, text.year_text, "abs(y)")
over("fn_year_range", YEARS, text.year_range, "abs(y)")
over("fn_year_iso", YEARS, text.year_iso, "abs(y)")
over("fn_year_label", "y", text.year_label)
over("fn_century", "y", text.century)
over("fn_dimensions", SIZES, text.centimetres, "p_size")
over("filter_junk_title", TITLES, text.junk_title, "p_size")
over("enr_blank_urls", ["@", "Q123", "Monet", "", "_:@"], lambda d, x: f"CASE WHEN {d.match(x, '^(https?://|_:|Q[0-9]+$)')} THEN NULL ELSE {x} END", "img")
over("dq_medium_from_note", ["This fresco shows a @", "An engraving of a @", "Oil on @, thickly laid", "No word of it: @"], lambda d, x: f"nullif({text.medium_bucket(d, x)}, {text.medium_fallback(d, x)})")


def sql_pair(name: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark_sql(spark, sf_dir, build(SPARK))
    ORACLES[name] = duck_sql(build(DUCK))


sql_pair("fn_text_clip", lambda d: f"SELECT doc_id, {text.clip(d, 'text')} AS clipped FROM documents")
sql_pair("fn_url_image_key", lambda d: f"SELECT page_id, {text.image_key(d, 'url')} AS image_key FROM pages")
BANDS = "SELECT * FROM (VALUES " + ", ".join(f"({a}, {z}, '{n}')" for a, z, n in ERAS) + ") AS b(lo, hi, band)"
QUERIES["fn_era_band"] = lambda spark, sf_dir: within(spark_sql(spark, sf_dir, "SELECT id, y FROM [[w]]"), "y", spark_sql(spark, sf_dir, BANDS), 500).select("id", "y", "band")
ORACLES["fn_era_band"] = duck_sql(f"SELECT w.id, w.y, b.band FROM [[w]] w JOIN ({BANDS}) b ON w.y BETWEEN b.lo AND b.hi")
sql_pair("fn_popularity", lambda d: f"SELECT id, {text.popularity(d, 'views', 'links', 'k % 50 = 0')} AS popularity FROM [[w]] WHERE views IS NOT NULL")
sql_pair("filter_bad_filename", lambda d: f"SELECT page_id, {d.ext('url', '[^/]+$')} AS file FROM pages WHERE {d.match(d.ext('url', '[^/]+$'), '(?i)verso|ref|page=2')}")
# Tables a caller brings: spellings, polities, nationalities and continents of the nations,
# variants of makers' and styles' names, and rules that place a text.
TABLES = {
    "spelling": "SELECT lower(n_name) AS variant, n_name AS name FROM nation UNION ALL SELECT concat('n', n_nationkey), n_name FROM nation",
    "polity": "SELECT lower(n_name) AS variant, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name FROM nation",
    "continent": "SELECT lower(n_name) AS variant, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "maker": "SELECT concat('Édouard ', s_name) AS variant, s_name AS name FROM supplier",
    "style": "SELECT DISTINCT concat('late ', p_type) AS variant, p_type AS name FROM part",
    "geocode": "SELECT n_nationkey AS ord, lower(n_name) AS pattern, n_nationkey * 37 % 180 - 90 AS lat, n_nationkey * 53 % 360 - 180 AS lng FROM nation",
}


def joined(name: str, forms: list[str], column: str, key, table: str, out) -> None:
    """As over, but the result is made from the input and what a table has for its key."""
    sql_pair(name, lambda d: f"""
SELECT q.id, q.x, {out(d, 'q.x', 't.name', 't.variant')} AS out FROM (SELECT id, x, {key(d, 'x')} AS variant FROM (SELECT id, {formed(d, forms, column)} AS x FROM [[w]]) w) q
LEFT JOIN ({TABLES[table]}) t ON t.variant = q.variant""")


joined("fn_artist_canon", MAKERS, "artist", text.artist_canon, "maker", lambda d, x, name, _: f"coalesce({name}, {text.artist_canon(d, x)})")
joined("fn_style_canon", STYLES, "style", lambda d, x: f"trim(coalesce({x}, ''))", "style", lambda d, x, name, _: text.style_canon(d, x, name, f"({x} <> 'french')"))
joined("fn_place_canon", PLACES, "place", lambda d, x: f"lower({text.place_parts(d, x)[0]})", "spelling", lambda d, x, name, _: text.place_canon(d, x, name))
joined("fn_place_polity", ["Kingdom of @", "@", "Duchy of @", "Peru"], "place", text.polity_key, "polity", lambda d, x, name, variant: f"CASE WHEN {variant} IS NULL THEN {x} ELSE {name} END")
# the first nation named in a text; the place as a whole, else its last part that is known
sql_pair("fn_place_demonym", lambda d: f"""
SELECT q.id, q.x, coalesce(t.name, '') AS out FROM (SELECT id, {formed(d, PLACES, 'place')} AS x FROM [[w]]) q
LEFT JOIN (SELECT lower(n_name) AS variant, n_name AS name FROM nation) t ON {d.ext('lower(q.x)', 'nation_[0-9]+')} = t.variant""")
sql_pair("fn_continent_name", lambda d: f"""
WITH q AS (SELECT id, x, {text.continent_place(d, 'x')} AS s FROM (SELECT id, {formed(d, PLACES, 'place')} AS x FROM [[w]]) w),
piece AS (SELECT id, {"generate_subscripts(string_split(s, ','), 1) AS i, trim(unnest(string_split(s, ','))) AS v FROM q" if d.duck else "i, trim(v) AS v FROM q LATERAL VIEW posexplode(split(s, ',')) p AS i, v"}),
known AS (SELECT p.id, max_by(c.name, p.i) AS name FROM piece p JOIN ({TABLES["continent"]}) c ON c.variant = p.v GROUP BY p.id)
SELECT q.id, q.x, coalesce(w.name, k.name, '') AS out FROM q LEFT JOIN ({TABLES["continent"]}) w ON w.variant = q.s LEFT JOIN known k ON k.id = q.id""")
# the first rule that matches the style, else the first that matches the place
sql_pair("geo_rule_geocode", lambda d: f"""
SELECT id, hit, lat, lng FROM (SELECT q.id, q.hit, r.lat, r.lng, row_number() OVER (PARTITION BY q.id ORDER BY q.way, r.ord) AS i FROM (
  SELECT id, 1 AS way, 'style' AS hit, lower(concat(style, ' of ', CASE WHEN k % 2 = 0 THEN place ELSE '' END)) AS x FROM [[w]] UNION ALL
  SELECT id, 2, 'place', lower({formed(d, PLACES, 'place')}) FROM [[w]]) q
JOIN ({TABLES["geocode"]}) r ON {"regexp_matches(q.x, r.pattern || '\\b')" if d.duck else "q.x RLIKE concat(r.pattern, '\\\\b')"}) z WHERE i = 1""")
sql_pair("dedup_name_variants", lambda d: f"SELECT fold, count(DISTINCT x) AS n FROM (SELECT x, {text.fold_key(d, 'x')} AS fold FROM (SELECT {formed(d, ['Édouard @', 'Edouard @', 'EDOUARD @', 'Claude @', 'Claude  @'], 'artist')} AS x FROM [[w]]) a) b GROUP BY fold HAVING count(DISTINCT x) > 1")
sql_pair("dedup_vocab_variants", lambda d: f"SELECT v, count(DISTINCT x) AS n, min(x) AS kept FROM (SELECT x, {d.sub(d.sub('lower(x)', '(art|painting|style|school|period)'), '[^a-z]')} AS v FROM (SELECT {formed(d, ['@ period', '@', '@ style', 'Gothic art', 'Gothic @', 'Rococo'], 'style')} AS x FROM [[w]]) a) b GROUP BY v HAVING count(DISTINCT x) > 1")
sql_pair("join_regex_rules", lambda d: f"""
SELECT id, x, value FROM (SELECT q.id, q.x, r.value, row_number() OVER (PARTITION BY q.id ORDER BY r.ord) AS i FROM (SELECT id, {formed(d, PLACES, 'place')} AS x FROM [[w]]) q
JOIN (SELECT n_nationkey AS ord, concat('(?i)', n_name, '($|[^0-9])') AS pattern, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey) r ON {"regexp_matches(q.x, r.pattern)" if d.duck else "q.x RLIKE r.pattern"}) z WHERE i = 1""")
BARE = ["Mask", "@", "Vessel fragment", "Garden carpet", "Opium Pipe", "The @ of 1923", "Head of a @", "Fragment.", "“Untitled”", "Strigil", "Panel: @"]
sql_pair("fn_popularity_guard", lambda d: f"""
SELECT id, title, artist, score, {text.guarded(d, 'score', 'title', 'artist')} AS guarded FROM (
  SELECT id, {formed(d, BARE, 'title')} AS title, artist, round({text.popularity(d, 'views', 'links', 'k % 50 = 0')}, 1) AS score FROM [[w]] WHERE views IS NOT NULL) q""")
# makers whose works are not free, works of theirs that are, and words of free licences
DENIED = "SELECT s_name AS term FROM supplier WHERE s_suppkey % 9 = 4"
EXCEPTED = "SELECT id FROM [[w]] WHERE k % 40 = 8"
FREE = "SELECT * FROM (VALUES ('cc0'), ('public domain')) AS v(term)"
CREDITS = ["@", "After @", "Studio of @", "@, with pupils", "Unknown"]
RIGHTS = ["CC0 1.0", "In copyright: @", "Public Domain Mark", "CC BY-NC", "cc0, @", "No known rights"]


def filter_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that name no denied maker, and the exceptions. Names are found by their tokens."""
    works = spark_sql(spark, sf_dir, f"SELECT id, {formed(SPARK, CREDITS, 'artist')} AS x FROM [[w]]")
    named = mentions(works, spark_sql(spark, sf_dir, DENIED), "id", "x").select("id").distinct()
    denied = named.join(spark_sql(spark, sf_dir, EXCEPTED), "id", "left_anti")
    return works.join(denied, "id", "left_anti")


QUERIES["filter_denylist"] = filter_denylist
ORACLES["filter_denylist"] = duck_sql(f"""
SELECT id, x FROM (SELECT id, {formed(DUCK, CREDITS, 'artist')} AS x FROM [[w]]) q
WHERE NOT EXISTS (SELECT 1 FROM ({DENIED}) n WHERE contains(q.x, n.term)) OR id IN ({EXCEPTED})""")


def filter_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose rights hold the words of a free licence, of the sources that say so."""
    rights = spark_sql(spark, sf_dir, f"SELECT id, {formed(SPARK, RIGHTS, 'artist')} AS x FROM [[c]] WHERE src_priority < 4")
    return rights.join(mentions(rights, spark_sql(spark, sf_dir, FREE), "id", "x").select("id").distinct(), "id", "left_semi")


QUERIES["filter_license"] = filter_license
ORACLES["filter_license"] = duck_sql(f"""
SELECT id, x FROM (SELECT id, {formed(DUCK, RIGHTS, 'artist')} AS x FROM [[c]] WHERE src_priority < 4) q WHERE EXISTS (SELECT 1 FROM ({FREE}) f WHERE contains(lower(q.x), f.term))""")


def fn_hash_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and a colour of each user, from two rolling hashes of the id's characters."""
    users = spark_sql(spark, sf_dir, "SELECT DISTINCT user_id FROM [[e]]")
    chars = F.transform(F.split(F.col("user_id").cast("string"), ""), lambda c: F.ascii(c).cast("long"))
    fold = lambda m: F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.pmod(a * m + c, F.lit(1 << 32)))
    return users.select("user_id", (fold(31) % 97).alias("name_no"), (fold(33) % 360).alias("hue"))


QUERIES["fn_hash_identity"] = fn_hash_identity
ORACLES["fn_hash_identity"] = duck_sql("""
WITH RECURSIVE u AS (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS s FROM [[e]]),
r AS (SELECT user_id, s, 0 AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM u
  UNION ALL SELECT user_id, s, i + 1, (a * 31 + ascii(substr(s, i + 1, 1))) % 4294967296, (b * 33 + ascii(substr(s, i + 1, 1))) % 4294967296 FROM r WHERE i < length(s))
SELECT user_id, a % 97 AS name_no, b % 360 AS hue FROM r WHERE i = length(s)""")


def fn_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of each question, stop words left out."""
    guides = spark_sql(spark, sf_dir, "SELECT conv_id, turn, q FROM [[g]]")
    tokens = F.array_except(F.split(F.regexp_replace(F.lower("q"), "[^a-z0-9]+", " "), " "), F.array(*map(F.lit, ["", *rules.STOP])))
    return guides.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("tokens"))


QUERIES["fn_token_set"] = fn_token_set
ORACLES["fn_token_set"] = duck_sql(f"""
WITH x AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM [[g]])
SELECT conv_id, turn, coalesce(string_agg(DISTINCT w, ' ' ORDER BY w) FILTER (w <> '' AND w NOT IN ({", ".join(f"'{s}'" for s in rules.STOP)})), '') AS tokens FROM x GROUP BY conv_id, turn""")
