"""Adapters, sinks and incremental loads: records are derived from the catalogue as texts,
then read by the adapter under test."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import md5
from unicodedata import combining, normalize

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.operators import tables
from atelier.operators.position import ensure_checkpoints, global_position
from atelier.queries.base import query, sql, view
from atelier.sources import adapters


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{uuid.uuid4().hex}"


def records(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Each work as one JSON text."""
    return view(spark, sf_dir, "w").select(F.to_json(F.struct(*[F.expr(f) for f in fields])).alias("j"))


@query("SELECT id, title, y FROM [[w]]")
def src_json_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = records(spark, sf_dir, "id", "title", "y").select(F.concat(F.lit("window.POOL = ["), "j", F.lit("];\n")).alias("t"))
    return adapters.module_rows(texts, "t", "id string, title string, y int")


@query("""
SELECT id, 0 AS src_priority, fame AS score FROM [[w]] WHERE k % 3 = 0 UNION ALL SELECT id, 1, NULL FROM [[w]] WHERE k % 3 = 1""")
def src_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "w")
    sources = [w.where("k % 3 = 0").select("id", F.col("fame").alias("score")), w.where("k % 3 = 1").select("id")]
    return tables.union_sources([sources[0], sources[1], None]).select("id", "src_priority", "score")


@query("SELECT doc_id, source, length(text) AS chars FROM documents")
def src_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    view(spark, sf_dir, "documents").select("doc_id", "source", "text").write.csv(folder, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = adapters.read_csv(spark, folder, ["doc_id", "source", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.length("text").cast("long").alias("chars"))


@query("SELECT id, title, place FROM [[w]]")
def src_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: f"CASE WHEN {c} IS NOT NULL THEN struct({c} AS value) END AS {c}"
    return adapters.bindings(records(spark, sf_dir, value("id"), value("title"), value("place")), "j", ["id", "title", "place"])


@query("SELECT id, CAST(floor((y + y + 21) / 2.0 + 0.5) AS INT) AS year, coalesce(nullif(style, ''), place) AS culture, CASE WHEN k % 10 = 0 THEN 50 ELSE 0 END AS boost FROM [[w]] WHERE k % 4 <> 0")
def src_nested_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "k % 4 <> 0 AS is_public_domain", "img AS image_id", "y AS date_start", "y + 21 AS date_end", "style AS style_title", "place AS place_of_origin", "k % 10 = 0 AS is_boosted")
    r = F.from_json("j", "id string, is_public_domain boolean, image_id string, date_start int, date_end int, style_title string, place_of_origin string, is_boosted boolean")
    d = j.select(r.alias("r")).select("r.*").where("is_public_domain AND image_id <> ''")
    mid = F.floor((F.col("date_start") + F.col("date_end")) / 2 + 0.5).cast("int")
    return d.select("id", F.coalesce(mid, "date_start", "date_end").alias("year"), adapters.first_filled(F.col("style_title"), F.col("place_of_origin")).alias("culture"), F.when(F.col("is_boosted"), 50).otherwise(0).alias("boost"))


@query("SELECT id, nullif(artist, '') AS creator, style AS culture, CASE WHEN k % 3 = 0 THEN concat(img, '#print') ELSE img END AS image FROM [[w]]")
def src_nested_cleveland(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "array(struct(artist AS description)) AS creators", "array(style, 'x') AS culture", "struct(CASE WHEN k % 3 <> 0 THEN struct(img AS url) END AS web, struct(concat(img, '#print') AS url) AS print) AS images")
    r = F.from_json("j", "id string, creators array<struct<description:string>>, culture array<string>, images struct<web:struct<url:string>,print:struct<url:string>>")
    d = j.select(r.alias("r")).select("r.*")
    return d.select("id", adapters.first_filled(F.col("creators")[0]["description"]).alias("creator"), F.element_at("culture", 1).alias("culture"), F.coalesce("images.web.url", "images.print.url").alias("image"))


@query("SELECT id, artist AS maker, k % 500 AS hint FROM [[w]] WHERE k % 5 <> 1")
def src_nested_harvard(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "k % 5 AS imagepermissionlevel", "array(struct('Donor' AS role, 'X' AS name), struct('Artist' AS role, artist AS name)) AS people", "k % 500 AS totalpageviews")
    r = F.from_json("j", "id string, imagepermissionlevel int, people array<struct<role:string,name:string>>, totalpageviews bigint")
    d = j.select(r.alias("r")).select("r.*").where("imagepermissionlevel <> 1")
    return d.select("id", F.get(F.filter("people", lambda p: p["role"] == "Artist"), F.lit(0))["name"].alias("maker"), F.col("totalpageviews").alias("hint"))


@query("SELECT id, coalesce(nullif(style, ''), place) AS kind FROM [[w]] WHERE k % 4 = 0")
def src_nested_smithsonian(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "array(style, '') AS object_type", "array(place) AS places", "array('Restricted', CASE WHEN k % 4 = 0 THEN 'CC0' ELSE 'Usage conditions apply' END) AS rights")
    r = F.from_json("j", "id string, object_type array<string>, places array<string>, rights array<string>")
    d = j.select(r.alias("r")).select("r.*").where(F.array_join("rights", " ").rlike("(?i)cc0|public domain"))
    return d.select("id", F.get(F.filter(F.concat("object_type", "places"), lambda x: x != ""), F.lit(0)).alias("kind"))


@query("SELECT id, CASE WHEN k % 7 = 0 THEN '' ELSE artist END AS maker, place FROM [[w]] WHERE k % 6 <> 0")
def src_nested_va(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(spark, sf_dir, "id", "array(CASE WHEN k % 7 = 0 THEN 'Unknown' ELSE artist END) AS makers").select(F.from_json("j", "id string, makers array<string>").alias("r")).select("r.*")
    detail = records(spark, sf_dir, "id", "place", "array(CASE WHEN k % 6 = 0 THEN 'low-res' ELSE 'ok' END) AS notes").select(F.from_json("j", "id string, place string, notes array<string>").alias("r")).select("r.*")
    whole = found.join(detail, "id").where(~F.exists("notes", lambda n: n == "low-res"))
    return whole.select("id", F.coalesce(F.get(F.filter("makers", lambda m: ~m.rlike("(?i)^unknown")), F.lit(0)), F.lit("")).alias("maker"), "place")


@query("SELECT id, coalesce(CASE WHEN k % 2 = 0 THEN place END, region, style) AS origin, CASE WHEN k % 9 = 0 THEN 100 ELSE 0 END AS hint FROM [[w]]")
def src_nested_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "CASE WHEN k % 2 = 0 THEN place ELSE '' END AS country", "region", "style AS culture", "k % 9 = 0 AS isHighlight")
    d = j.select(F.from_json("j", "id string, country string, region string, culture string, isHighlight boolean").alias("r")).select("r.*")
    return d.select("id", F.coalesce(adapters.first_filled(F.col("country"), F.col("region")), "culture").alias("origin"), F.when(F.col("isHighlight"), 100).otherwise(0).alias("hint"))


@query("SELECT id, concat(img, '#tile') AS tile, CAST(1900 + k % 50 AS INT) AS year FROM [[w]] WHERE artist <> ''")
def src_nested_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = records(spark, sf_dir, "id", "array(artist) AS contributor", "array(img, concat(img, '#tile')) AS image_url", "CASE WHEN k % 2 = 0 THEN concat('between ', 1900 + k % 50, ' and') END AS date", "concat('[', 1900 + k % 50, ']') AS created")
    d = j.select(F.from_json("j", "id string, contributor array<string>, image_url array<string>, date string, created string").alias("r")).select("r.*")
    year = lambda c: F.when(F.regexp_extract(c, "([0-9]{4})", 1) != "", F.regexp_extract(c, "([0-9]{4})", 1).cast("int"))
    tile = F.element_at(F.filter("image_url", lambda u: u.endswith("#tile")), -1)
    return d.where(F.element_at("contributor", 1) != "").select("id", tile.alias("tile"), F.coalesce(year("date"), year("created")).alias("year"))


@query("SELECT id, title FROM [[w]]")
def sink_publish_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.publish(view(spark, sf_dir, "w").select("id", "title"), shared_folder(spark), "id")


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 8 AS INT) AS shard FROM [[w]]")
def sink_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.shards(global_position(view(spark, sf_dir, "w").select("id"), [F.asc("id")]), 8).select("id", "shard")


sql("inc_todo_set", "SELECT id FROM [[w]] WHERE id NOT IN (SELECT id FROM [[w]] WHERE k % 2 = 0)")
sql("inc_remaining", "SELECT w.id, w.title, w.artist FROM [[w]] w LEFT ANTI JOIN [[c]] c ON c.id = w.id", oracle="SELECT w.id, w.title, w.artist FROM [[w]] w WHERE w.id NOT IN (SELECT id FROM [[c]])")
sql("export_review_queue", """
WITH q AS (SELECT id, 'artist' AS kind FROM [[w]] WHERE artist = '' UNION ALL SELECT id, 'style' FROM [[w]] WHERE style = '' UNION ALL SELECT id, 'place' FROM [[w]] WHERE place IS NULL),
n AS (SELECT kind, count(*) AS n_kind FROM q GROUP BY kind)
SELECT q.id, q.kind, w.title, n.n_kind, CASE q.kind WHEN 'artist' THEN 0 WHEN 'style' THEN 1 ELSE 2 END AS ord FROM q JOIN n ON n.kind = q.kind LEFT JOIN [[w]] w ON w.id = q.id""")


@query("SELECT style, src, id FROM (SELECT *, row_number() OVER (PARTITION BY style, src ORDER BY fame DESC NULLS LAST, id) AS i FROM [[w]]) x WHERE i = 1 AND style <> '' UNION ALL SELECT style, src, id FROM [[w]] WHERE style = ''")
def ext_dedup_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("style") != "", F.concat_ws("|", "style", "src"))
    return tables.dedup_by(view(spark, sf_dir, "w"), key, [F.desc_nulls_last("fame"), F.asc("id")]).select("style", "src", "id")


@query("SELECT v AS value, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT concat(substr(title, 1, 3), '-', k % 4) AS v FROM [[w]]) x GROUP BY v")
def ext_tally_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tally(view(spark, sf_dir, "w"), F.concat(F.substring("title", 1, 3), F.lit("-"), F.col("k") % 4))


@query("""
WITH x AS (SELECT user_id, ts, event_id, CASE WHEN total > lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM [[e]]),
y AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM y GROUP BY user_id, g) z GROUP BY user_id""")
def ext_group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold in order over each user's events: the longest run of rising totals. Events come
    sorted through Arrow, many users a batch; each user's day, or the part of it that a batch
    holds, folds to a piece, and the pieces, a row for each, are merged in order. No task holds
    a user's events, and none is called for each user or day."""
    events = view(spark, sf_dir, "e").select("user_id", "dn", "ts", "event_id", "total")
    return longest_rises(events)


#: Events of a user's day that follow each other: where they begin, how many, the first and last
#: total, the rising runs at both ends, the longest one.
PIECE = "user_id long, ts timestamp, event_id long, n long, first long, last long, head long, tail long, best long"


def longest_rises(events: DataFrame) -> DataFrame:
    """user_id and longest of events (user_id, dn, ts, event_id, total)."""
    order = ["user_id", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")]
    days = events.repartition("user_id", "dn").sortWithinPartitions("user_id", "dn", *order[1:])
    pieces = days.mapInArrow(fold_days, PIECE)
    return pieces.repartition("user_id").sortWithinPartitions(*order).mapInArrow(merge_pieces, "user_id long, longest long")


def fold_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A PIECE for each user's day in a batch of sorted events."""
    for batch in batches:
        held = batch.to_pydict()
        of, totals, starts, out = list(zip(held["user_id"], held["dn"])), held["total"], [], []
        for i, total in enumerate(totals):
            if not i or of[i] != of[i - 1]:
                starts.append(i)
                out.append([0, total, total, 0, 0, 0])
                run = 0
            piece = out[-1]
            # a missing total ends a run and begins one
            run = run + 1 if run and None not in (total, piece[2]) and total > piece[2] else 1
            piece[0] += 1
            piece[2] = total
            piece[3] = run if run == piece[0] else piece[3]
            piece[4] = run
            piece[5] = max(piece[5], run)
        begun = batch.select(["user_id", "ts", "event_id"]).take(pa.array(starts, pa.int64()))
        made = [pa.array(c, pa.int64()) for c in zip(*out)]
        if made:
            yield pa.RecordBatch.from_arrays([*begun.columns, *made], names=[c.split()[0] for c in PIECE.split(", ")])


def merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest run of each user, of sorted PIECEs; what the user at hand has goes on from
    batch to batch."""
    at, best = (), 0
    for batch in batches:
        users, longest = [], []
        held = [batch.column(c).to_pylist() for c in ("user_id", "n", "first", "last", "head", "tail", "best")]
        for user, n, first, final, head, tail, most in zip(*held):
            if at != (user,):
                if at:
                    users += at
                    longest.append(best)
                at, best, run, last = (user,), 0, 0, None
            joined = run if run and None not in (first, last) and first > last else 0
            best = max(best, most, joined + head)
            run = joined + n if head == n else tail
            last = final
        yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(longest, pa.int64())], names=["user_id", "longest"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([best], pa.int64())], names=["user_id", "longest"])


@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents WHERE text IS NOT NULL")
def ext_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over batches of bounded size, for what no built-in one does: the digest of
    each text without its accents."""

    def plain(batches):
        for pdf in batches:
            bare = [md5("".join(c for c in normalize("NFD", t) if not combining(c)).encode()).hexdigest() for t in pdf.text]
            yield pdf.assign(plain=bare)[["doc_id", "plain"]]

    docs = view(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return docs.mapInPandas(plain, "doc_id long, plain string")
