"""The catalogue's tables, as views over the star schema: works, candidates, triples,
submissions and guides. Each view has one SQL text; where Spark and DuckDB differ, a
`{spark|duck}` pair in double brackets picks the form."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

VIEWS = {
    "w": """
WITH li AS (SELECT l_partkey, count(*) AS views, count(DISTINCT l_suppkey) AS links, min(l_suppkey) AS maker_key
            FROM lineitem GROUP BY l_partkey)
SELECT concat('w', p_partkey) AS id, p_partkey AS k, p_name AS title,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE s_name END AS artist,
  CAST((p_partkey * 37) % 5000 AS INT) - 2976 AS y, n_name AS place, r_name AS region,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS style,
  CASE WHEN p_partkey % 3 = 0 THEN 'culture' ELSE 'movement' END AS style_kind,
  p_brand AS src, views, links, round(120 * ln(views + 1) + 8 * ln(links + 1), 6) AS fame,
  concat('http://img.example.org/', p_name, '.jpg?width=', p_size * 100) AS img, p_size
FROM part LEFT JOIN li ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = maker_key
LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "c": """
SELECT concat('w', k + 1000) AS id, k,
  CASE WHEN k % 3 = 0 THEN lower(title) WHEN k % 3 = 1 THEN replace(title, 'e', 'é') ELSE title END AS title,
  artist, CASE WHEN k % 13 = 0 THEN NULL ELSE y END AS year, place,
  CASE WHEN style_kind = 'culture' THEN style ELSE '' END AS culture,
  CASE WHEN style_kind = 'movement' THEN style ELSE '' END AS movement,
  CASE WHEN k % 17 = 0 THEN '' ELSE img END AS image, src, CAST(k % 5 AS INT) AS src_priority, fame AS fame_hint
FROM [[w]]""",
    "t": """
SELECT concat('w', p_partkey) AS s, 'P31' AS p, concat('type:', p_type) AS o, 0 AS ord FROM part
UNION ALL SELECT DISTINCT concat('w', l_partkey), 'P170', concat('m', l_suppkey), 0 FROM lineitem
UNION ALL SELECT concat('m', s_suppkey), 'P27', concat('c', s_nationkey), 0 FROM supplier
UNION ALL SELECT concat('m', s_suppkey), 'P19', concat('c', (s_suppkey * 7) % 25), 0 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT concat('m', s_suppkey), 'P937', concat('c', (s_suppkey * 3 + x) % 25), 0 FROM supplier, (VALUES (0), (1), (3)) AS v(x)
UNION ALL SELECT concat('m', s_suppkey), 'P570', CAST(1900 + s_suppkey % 100 AS {STRING|VARCHAR}), 0 FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT concat('w', p_partkey), 'P1071', concat('c', p_partkey % 25), 0 FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT concat('w', p_partkey), 'P186', CASE WHEN x = 0 THEN 'wood' WHEN p_partkey % 3 = 0 THEN 'oil paint' ELSE 'tempera' END, x
  FROM part, (VALUES (0), (1)) AS v(x)
UNION ALL SELECT concat('c', n_nationkey), 'P30', concat('r', n_regionkey), 0 FROM nation
UNION ALL SELECT concat('c', n_nationkey), 'label', n_name, 0 FROM nation
UNION ALL SELECT concat('t', p_partkey), 'P279', concat('t', CAST(floor(p_partkey / 2) AS BIGINT)), 0 FROM part WHERE p_partkey > 0""",
    "e": """
SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d,
  CAST({unix_date(CAST(ts AS DATE))|CAST(ts AS DATE) - DATE '1970-01-01'} AS BIGINT) AS dn,
  CASE event_type WHEN 'view' THEN 'easy' WHEN 'click' THEN 'medium' WHEN 'signup' THEN 'hard' WHEN 'error' THEN 'impossible' ELSE 'save' END AS tier,
  CAST(floor(value * 100) AS BIGINT) AS total, CAST({get_json_object(props, '$.k')|json_extract_string(props, '$.k')} AS BIGINT) AS k
FROM events""",
    "g": """
SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
    # the calendar: an edition for each nation, 20 days, four tiers, five works a day from a ring
    "cal": """
SELECT n.n_nationkey AS edition, CAST(19700 + x.d AS BIGINT) AS dn, t.tier, CAST(s.slot AS INT) AS slot,
  concat('w', (n.n_nationkey * 131 + t.i * 17 + (x.d * 5 + s.slot) * 3) % m.n) AS id
FROM nation n, (SELECT CAST(x AS BIGINT) AS d FROM {(SELECT explode(sequence(0, 19)) AS x)|(SELECT unnest(range(20)) AS x)}) AS x,
  (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard'), (3, 'impossible')) AS t(i, tier),
  (VALUES (0), (1), (2), (3), (4)) AS s(slot), (SELECT count(*) AS n FROM part) AS m""",
}

_PAIR = re.compile(r"\{([^{}|]*)\|([^{}]*)\}")


def text(sql: str, duck: bool) -> str:
    """The Spark or the DuckDB form of a text with {spark|duck} pairs."""
    return _PAIR.sub(lambda m: m[2] if duck else m[1], sql)


def needed(sql: str) -> list[str]:
    """The views a text names as [[view]], and those they name, in order of definition."""
    found: list[str] = []
    for v in re.findall(r"\[\[(\w+)\]\]", sql):
        for x in [*needed(VIEWS[v]), v]:
            if x not in found:
                found.append(x)
    return found


def duck_sql(sql: str) -> str:
    """A DuckDB text with its views as common table expressions."""
    names = needed(sql)
    body = re.sub(r"\[\[(\w+)\]\]", r"v_\1", text(sql, True))
    views = ", ".join(f"v_{n} AS ({re.sub(r'\[\[(\w+)\]\]', r'v_\1', text(VIEWS[n], True))})" for n in names)
    if not views:
        return body
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if head:
        return f"WITH {head[1] or ''}{views}, {body[head.end():]}"
    return f"WITH {views} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run a text over the tables of sf_dir, the views and the given frames, all named in it
    as [[name]]; plain table names are read too."""
    body = text(sql, False)
    # braces that are left belong to SQL and are doubled for the formatter
    names = set(re.findall(r"\[\[(\w+)\]\]", body))
    body = body.replace("{", "{{").replace("}", "}}")
    body = re.sub(r"\[\[(\w+)\]\]", r"{\1}", body)
    used = {n: frames[n] if n in frames else view(spark, sf_dir, n) for n in names}
    for n in TABLES:
        if n not in names and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", body, re.IGNORECASE):
            body = re.sub(rf"(\b(?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", body, flags=re.IGNORECASE)
            used[n] = table(spark, sf_dir, n)
    return spark.sql(body, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the catalogue, or a table of sf_dir."""
    return spark_sql(spark, sf_dir, VIEWS[name]) if name in VIEWS else table(spark, sf_dir, name)
