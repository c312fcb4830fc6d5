"""Host-level quality rules, with DataFrame functions only.

Every document is measured against per-document rules. Failures are added up by host, the
failure rates are shrunk towards a beta prior fitted to the rates of all hosts (method of
moments), and a host whose shrunk rate of any rule is too high has all its documents
dropped. Documents that fail the base rule are dropped in any case.

A null text has no words. A null host is a host of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import SPACE, cut, words

#: A host is dropped where its shrunk failure rate is above the limit of any rule.
LIMITS = {"base_failed": 0.75, "symbols_failed": 0.75, "lines_failed": 0.75}
#: Up to so many repeated windows of a text are looked up one by one; more are sorted.
FEW = 48


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; the input
    must hold none of these and no column that begins with an underscore."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_words", words(whole))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": lines,
            "_windows": F.expr(
                "if(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3),"
                " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
            ).cast("array<bigint>"),
        }
    ).drop("_words")
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("_sorted", F.array_sort("_windows"))
    # windows found twice or more: where a sorted neighbour is the same
    df = df.withColumn("_twice", F.expr("array_distinct(filter(_sorted, (x, i) -> i > 0 and x = _sorted[i - 1]))"))
    df = df.drop("_sorted")
    few = "filter(transform(_windows, (x, i) -> if(array_contains(_twice, x), i, null)), i -> i is not null)"
    df = df.withColumn(
        "_pairs",
        F.expr(f"if(size(_twice) <= {FEW}, cast(array() as array<struct<x:bigint,i:int>>), array_sort(transform(_windows, (x, i) -> struct(x, i))))"),
    )
    many = (
        "array_sort(transform(filter(_pairs, (p, k) -> (k > 0 and p.x = _pairs[k - 1].x) or"
        " (k < size(_pairs) - 1 and p.x = _pairs[k + 1].x)), p -> p.i))"
    )
    df = df.withColumn("_at", F.expr(f"case when size(_twice) = 0 then cast(array() as array<int>) when size(_twice) <= {FEW} then {few} else {many} end"))
    # each window covers three words, less what the next one covers too
    covered = F.expr("aggregate(zip_with(_at, slice(_at, 2, greatest(size(_at), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, n) -> s + n)")
    return df.withColumn("n_repeat_words", covered).drop("_windows", "_twice", "_pairs", "_at")


def verdicts(rules: DataFrame, host: str, names: list[str]) -> DataFrame:
    """One row for each host (column host, null included): n_docs, and for each boolean rule
    its failures and its shrunk rate."""
    totals = rules.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names]
    )
    totals = cut(totals)
    moments = totals.agg(
        *[F.avg(F.col(n) / F.col("n_docs")).alias(f"m_{n}") for n in names],
        *[F.var_pop(F.col(n) / F.col("n_docs")).alias(f"v_{n}") for n in names],
    ).first()
    for n in names:
        mean, var = moments[f"m_{n}"] or 0.0, moments[f"v_{n}"] or 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
        shrunk = (F.col(n) + mean * strength) / (F.col("n_docs") + strength)
        totals = totals.withColumn(f"rate_{n}", shrunk)
    return totals


def apply_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limits: dict[str, float] = LIMITS) -> DataFrame:
    """key, the measures, base_failed, host_rate (the shrunk base rate of its host),
    host_failed and kept of every row."""
    df = measured(docs.select(F.col(key).alias("k"), F.col(host).alias("h"), F.col(text).alias("t")), "t").drop("t")
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols_failed": 10 * F.col("n_symbols") > F.col("n_words"),
            "lines_failed": 5 * F.col("n_dup_lines") > F.col("n_words"),
        }
    )
    df = cut(df)
    hosts = verdicts(df, "h", list(limits))
    failed: Column = F.lit(False)
    for name, most in limits.items():
        failed = failed | (F.col(f"rate_{name}") > most)
    hosts = hosts.select("host", F.col("rate_base_failed").alias("host_rate"), failed.alias("host_failed"))
    out = df.join(hosts, F.col("h").eqNullSafe(F.col("host")))
    return out.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("host_rate", 9).alias("host_rate"), "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )


ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
raw as (
  select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i
  from (select doc_id, regexp_split_to_array(t, '[\x20\x09-\x0D]+') ws from d)
),
w as (select doc_id, w, row_number() over (partition by doc_id order by i) i from raw where w <> ''),
tri as (
  select doc_id, i, w || ' ' || lead(w) over p || ' ' || lead(w, 2) over p g
  from w window p as (partition by doc_id order by i)
),
twice as (select doc_id, g from tri where g is not null group by doc_id, g having count(*) > 1),
cover as (
  select doc_id, count(distinct i + o) n_repeat_words
  from tri join twice using (doc_id, g) cross join (values (0), (1), (2)) v(o) group by doc_id
),
counted as (select doc_id, count(*) n_words, sum(length(w)) word_chars from w group by doc_id),
ln as (select doc_id, unnest(string_split(t, chr(10))) l from d),
dup as (
  select doc_id, count(*) - count(distinct l) n_dup_lines
  from ln where regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '' group by doc_id
),
m as (
  select doc_id, source, coalesce(n_words, 0)::bigint n_words, coalesce(word_chars, 0)::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint n_repeat_words
  from d left join counted using (doc_id) left join dup using (doc_id) left join cover using (doc_id)
),
r as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    10 * n_symbols > n_words symbols_failed, 5 * n_dup_lines > n_words lines_failed from m
),
h as (
  select source, count(*) n, sum(base_failed::int) f1, sum(symbols_failed::int) f2, sum(lines_failed::int) f3 from r group by source
),
p as (
  select least(greatest(avg(f1 / n), 1e-6), 1 - 1e-6) m1, var_pop(f1 / n) v1, least(greatest(avg(f2 / n), 1e-6), 1 - 1e-6) m2, var_pop(f2 / n) v2,
    least(greatest(avg(f3 / n), 1e-6), 1 - 1e-6) m3, var_pop(f3 / n) v3 from h
),
s as (
  select *, case when v1 > 0 then least(greatest(m1 * (1 - m1) / v1 - 1, 1.0), 1e6) else 1e6 end s1,
    case when v2 > 0 then least(greatest(m2 * (1 - m2) / v2 - 1, 1.0), 1e6) else 1e6 end s2,
    case when v3 > 0 then least(greatest(m3 * (1 - m3) / v3 - 1, 1.0), 1e6) else 1e6 end s3 from p
),
v as (
  select source, (f1 + m1 * s1) / (n + s1) host_rate,
    (f1 + m1 * s1) / (n + s1) > 0.75 or (f2 + m2 * s2) / (n + s2) > 0.75 or (f3 + m3 * s3) / (n + s3) > 0.75 host_failed
  from h, s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) host_rate,
  host_failed, not base_failed and not host_failed kept
from r join v on r.source is not distinct from v.source
"""
