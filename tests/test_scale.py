"""Work that grows no faster than the input, and the same results however it is cut."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [3, 10000])
def test_rises_in_pieces(spark, most):
    """Runs that go on over days, batches and missing totals."""
    from atelier.queries import sources

    rng, rows, want = random.Random(3), [], {}
    for user in [*range(6), None]:
        run, last, want[user] = 0, None, 0
        for i in range(60):
            total = rng.choice([None, *range(40)]) if user != 5 else i
            ts = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=5 * (i // 2))
            rows.append((user, (5 * (i // 2)) // 24, ts, i, total))
            run = run + 1 if run and None not in (total, last) and total > last else 1
            last, want[user] = total, max(want[user], run)
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "user_id long, dn long, ts timestamp, event_id long, total long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        found = sources.longest_rises(events)
        assert sorted(map(str, found.collect())) == sorted(f"Row(user_id={u}, longest={n})" for u, n in want.items())
        assert sources.longest_rises(events.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_terms_with_a_common_token(spark):
    """A text of many words that all open terms: it meets the terms that it mentions, no others."""
    from atelier.operators import vocabulary

    words = [f"w{i}" for i in range(300)]
    terms = spark.createDataFrame([(w,) for w in words] + [(f"the {w}",) for w in words] + [(f"{w} the",) for w in words], "term string")
    docs = spark.createDataFrame([(k, "the " * 40 + f"the w{k} the") for k in range(50)], "i long, text string")
    found = vocabulary.mentions(docs, terms, "i", "text")
    assert {tuple(r) for r in found.collect()} == {(k, t) for k in range(50) for t in (f"w{k}", f"the w{k}", f"w{k} the")}
    assert {tuple(r) for r in vocabulary.outermost(found, terms, "i").collect()} == {(k, t) for k in range(50) for t in (f"the w{k}", f"w{k} the")}
    condition = found._jdf.queryExecution().optimizedPlan().toString()
    # the join is on whole runs; nothing is compared after it
    assert "slice(here" not in condition and condition.count("Join") == 1


@pytest.mark.parametrize("name", ["geo_ring_simplify", "geo_ring_clip_box"])
def test_rings_are_made_once(spark, sf, name):
    from atelier.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("cos(") == 1 and plan.count("sin(") == 1
    assert "window" not in plan and "sort" not in plan


def test_points_at_one_place_are_measured_once(spark, monkeypatch):
    from atelier.operators import cells
    from atelier.queries import geography

    edges = spark.createDataFrame([("box", 0.0, 0.0, 9.0, 0.0), ("box", 9.0, 0.0, 9.0, 9.0), ("box", 9.0, 9.0, 0.0, 9.0), ("box", 0.0, 9.0, 0.0, 0.0)], "name string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(k, *[(4.0, 4.0), (20.0, 4.0), (4.5, 30.0)][k % 3]) for k in range(90)], "k long, lat double, lng double")
    met, border = [], cells.nearest_border
    monkeypatch.setattr(cells, "nearest_border", lambda p, *more: (met.append(p.count()), border(p, *more))[1])
    found = {r.k: (r.name, round(r.km), r.held) for r in geography.by_place(points, edges).collect()}
    want = {r.k: (r.name, round(r.km)) for r in border(points, edges).collect()}
    assert met == [3] and {k: v[:2] for k, v in found.items()} == want and all(found[k][2] == (k % 3 == 0) for k in range(90))


def test_a_table_reads_its_key_once():
    from atelier.functions import text
    from atelier.functions.dialect import SPARK

    assert text.medium_family(SPARK, "KEY").count("KEY") == 1


def test_below_keeps_a_row_a_node(spark):
    """Chains, rings, nodes with several edges: the same depths as all paths give; a wide tree
    is followed without a row for each pair."""
    from atelier.operators import graph

    rng = random.Random(12)
    edges = [(f"n{i}", f"n{rng.randrange(25)}") for i in range(25) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    edges += [(f"c{i + 1}", f"c{i}") for i in range(40)] + [("c0", "n3"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("lone", "end"), ("n3", "n7")]
    df = spark.createDataFrame(edges, "s string, o string")
    for root in ("n3", "n7", "end", "r1", "none"):
        want, near, depth = {}, {root}, 0
        while near:
            depth += 1
            near = {s for s, o in edges if o in near and s != root and s not in want}
            want |= {s: depth for s in near}
        got = [tuple(r) for r in graph.below(df, root).collect()]
        assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["dq_place_provenance", "geo_footprint_fix", "agg_creator_stats"])
def test_tasks_of_makings_grow_with_the_table(spark, sf, monkeypatch, name):
    """Works are dealt to tasks of so many rows, not to a number of tasks that stays."""
    from atelier.plans import makers
    from atelier.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    want = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    for each in (rows // 3 + 1, 100):
        monkeypatch.setattr(makers, "ROWS", each)
        found = QUERIES[name](spark, sf)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert f"], {-(-rows // each)}" in plan.partition("RepartitionByExpression")[2].partition("\n")[0]
        assert sorted(map(tuple, found.collect()), key=str) == want
    # the pairs of works and makers are not sorted for the join with the makers
    assert "SortMergeJoin [m" not in found._jdf.queryExecution().executedPlan().toString()


def _sent(df):
    """The rows that the shuffles of a table have written."""
    df.collect()

    def of(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_runs_that_are_no_terms_are_not_sent(spark):
    """Texts of 10,000 runs that are no terms, and 50 mentions, with too many terms to broadcast."""
    from atelier.operators import vocabulary

    docs = spark.range(50).selectExpr("id AS i", "concat_ws(' ', 'amber', transform(sequence(1, 100), x -> concat('w', id, 'x', x)), 'dome') AS text")
    terms = spark.range(1000).selectExpr("CASE id WHEN 0 THEN 'amber' WHEN 1 THEN 'two words' ELSE concat('t', id) END AS term")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vocabulary.mentions(docs, terms, "i", "text")
        assert _sent(found) < 3000
        assert {tuple(r) for r in found.collect()} == {(k, "amber") for k in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["dq_style_from_note", "dq_style_vs_text", "join_contains_vocab"])
def test_texts_that_share_a_key(spark, sf, tmp_path, name):
    """A key counts once, however many texts have it; so does the null key."""
    import duckdb

    from atelier.queries import ORACLES, QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.where("doc_id < 60").selectExpr("CASE WHEN doc_id < 5 THEN NULL ELSE doc_id - 1 END AS doc_id", *[c for c in docs.columns if c != "doc_id"])
    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        if table.stem != "documents":
            (tmp_path / table.name).symlink_to(table)
            con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    docs.unionByName(other).unionByName(docs.where("doc_id < 20")).write.parquet(f"{tmp_path}/documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [str(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(map(str, con.sql(ORACLES[name]).fetchall())) and got
