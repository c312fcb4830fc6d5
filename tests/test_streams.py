"""Streams over several batches: state that ends, late rows, windows, feeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from atelier.queries import streams
from atelier.streaming import runs, state

T0 = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)
SCHEMA = "user_id long, event_id long, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream with a batch for each list of rows (user, event, minutes after ten)."""

    def made(*batches):
        for k, rows in enumerate(batches):
            df = spark.createDataFrame([(u, e, T0 + dt.timedelta(minutes=m)) for u, e, m in rows], SCHEMA).coalesce(1)
            df.write.parquet(str(tmp_path / f"x{k}"))
            [file] = (tmp_path / f"x{k}").glob("part-*.parquet")
            (tmp_path / "all").mkdir(exist_ok=True)
            file.rename(tmp_path / "all" / f"{k}.parquet")
        return runs.read_files(spark, str(tmp_path / "all"), SCHEMA)

    return made


def test_rate_limit_over_batches(stream):
    events = stream(
        [(1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 4, 5)],
        [(1, 5, 59), (1, 6, 60), (2, 7, 30), (2, 8, 31)],
        [(1, 9, 61), (1, 10, 90), (3, 11, 300)],  # the watermark passes to 240 minutes
        [(1, 12, 20), (1, 13, 241)],  # 12 is late; the window of user 2 ends by its timer
        [(2, 14, 310)],
    ).withWatermark("ts", "60 minutes").withColumn("t", F.unix_seconds("ts"))
    out = runs.to_completion(state.rate_limited(events.select("user_id", "event_id", "t", "ts"), 2, 3600), "append")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 4, 6, 7, 9, 11, 13, 14]


def _processor(kind, *args):
    """A processor over a dictionary of states, to see what its state and timers are."""

    class Value:
        held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Map(dict):
        containsKey = dict.__contains__  # noqa: N815
        updateValue = dict.__setitem__  # noqa: N815
        removeKey = dict.__delitem__  # noqa: N815

    class Handle:
        timers: set = set()

        getValueState = lambda self, *a: Value()  # noqa: E731, N815
        getMapState = lambda self, *a: Map()  # noqa: E731, N815

        def registerTimer(self, at):  # noqa: N802
            self.timers = self.timers | {at}

        def deleteTimer(self, at):  # noqa: N802
            self.timers = self.timers - {at}

    p = kind(*args)
    p.init(Handle())
    return p


def test_rate_limit_state_ends_an_hour_after_it_opens():
    import pandas as pd

    p = _processor(state.RateLimit, 2, 3600)
    rows = lambda *t: iter([pd.DataFrame({"t": [x], "event_id": [x]}) for x in t])
    assert next(p.handleInputRows((1,), rows(300, 100, 200), None)).event_id.tolist() == [100, 200]
    assert p.window.held == (100, 2) and p.handle.timers == {3700_000}
    assert next(p.handleInputRows((1,), rows(3700), None)).event_id.tolist() == [3700]
    assert p.window.held == (3700, 1) and p.handle.timers == {7300_000}
    assert len(next(p.handleExpiredTimer((1,), None, None))) == 0
    assert p.window.held is None


def test_progress_forgets_days_that_are_over():
    import pandas as pd

    class Expired:
        getExpiryTimeInMs = staticmethod(lambda: 11 * state.DAY_MS)  # noqa: N815

    p = _processor(state.Progress)
    frame = lambda *x: iter([pd.DataFrame(x, columns=["dn", "total"])])
    assert next(p.handleInputRows((1,), frame((10, 5), (10, 7), (11, 1)), None)).values.tolist() == [[1, 2, 11, 7]]
    assert next(p.handleInputRows((1,), frame((10, 9)), None)).values.tolist() == [[1, 2, 11, 9]]
    assert p.handle.timers == {11 * state.DAY_MS, 12 * state.DAY_MS}
    next(p.handleExpiredTimer((1,), None, Expired))
    assert set(p.open) == {(11,)} and p.totals.held == (2, 11, 9)


def test_progress_over_batches(stream):
    day = 1440
    events = stream([(1, 1, 0), (1, 2, 30), (2, 3, 0)], [(1, 4, day), (1, 5, 40)], [(2, 6, 5 * day)], [(1, 7, 10), (1, 8, 5 * day)])
    events = events.withWatermark("ts", "1 day").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("dn"), F.col("event_id").alias("total"), "ts")
    out = runs.to_completion(state.progress(events), "update", ["user_id"])
    first = 19723
    assert sorted(tuple(r) for r in out.select("user_id", "days", "last_day", "best").collect()) == [(1, 3, first + 5, 8), (2, 2, first + 5, 6)]


def test_days_merge_over_batches(stream):
    day = 1440
    events = stream([(1, 1, 0), (1, 2, 30), (2, 3, 0)], [(1, 4, day), (1, 5, 40)], [(2, 6, 5 * day)], [(1, 7, 10), (1, 8, 5 * day)])
    events = events.select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("dn"), F.col("event_id").alias("total"), "ts")
    out = streams.merged(streams.day_bests(events))
    first = 19723
    assert sorted(tuple(r) for r in out.select("user_id", "days", "last_day", "best").collect()) == [(1, 3, first + 5, 8), (2, 2, first + 5, 6)]


def test_days_need_no_call_for_each_key(spark, sf, monkeypatch):
    plans, run = [], streams.to_completion
    monkeypatch.setattr(streams, "to_completion", lambda s, *a: plans.append(s._jdf.queryExecution().analyzed().toString()) or run(s, *a))
    found = streams.st_state_merge(spark, sf)
    assert len(plans) == 1 and not any(x in plans[0] for x in ("Pandas", "Python", "TransformWithState"))
    assert found.columns == ["user_id", "days", "last_day", "best"] and found.count() > 0


def test_windows_over_batches_with_late_rows(spark, stream):
    events = stream([(1, 1, 0), (1, 2, 20), (1, 3, 70)], [(1, 4, 50), (1, 5, 400)], [(1, 8, 405)], [(1, 6, 30), (1, 7, 410)])  # 6 comes two batches after 400
    hours = runs.to_completion(streams.counts_by(spark, events, F.window("ts", "1 hour")), "update", ["user_id", "start"])
    assert sorted((int(r.start.timestamp() - T0.timestamp()) // 60, r.n) for r in hours.collect()) == [(0, 3), (60, 1), (360, 3)]
    sessions = runs.to_completion(streams.counts_by(spark, events, F.session_window("ts", "30 minutes")), "append")
    found = sorted((int(r.start.timestamp() - T0.timestamp()) // 60, int(r.end.timestamp() - T0.timestamp()) // 60, r.n) for r in sessions.collect())
    # half an hour apart is one session still; the one of 400 is not over
    assert found == [(0, 100, 4)]


def test_sliding_windows_overlap(spark, stream):
    slides = streams.counts_by(spark, stream([(1, 1, 0), (1, 2, 40)]), F.window("ts", "1 hour", "30 minutes"))
    found = runs.to_completion(slides, "update", ["user_id", "start"]).collect()
    assert sorted((int(r.start.timestamp() - T0.timestamp()) // 60, r.n) for r in found) == [(-30, 1), (0, 2), (30, 1)]


def test_feed_is_newest_first_and_capped(spark):
    rows = [(1, k, (T0 + dt.timedelta(minutes=k), k, k != 5)) for k in range(8)] + [(2, 1, (T0, 9, True))]
    actions = spark.createDataFrame(rows, "user_id long, k long, last struct<ts: timestamp, event_id: long, saved: boolean>")
    found = streams.saved_first(actions, 3)
    assert sorted(map(tuple, found.collect())) == [(1, 4, 3), (1, 6, 2), (1, 7, 1), (2, 1, 1)]
    # each task keeps at most so many rows of a device before the shuffle
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_reserved_names(spark):
    events = spark.createDataFrame([(1, 7, "Ann"), (2, 8, "ANN"), (3, 9, "ann"), (4, 9, "Bob"), (5, 7, "Cleo")], "event_id long, device long, brought string")
    accounts = spark.createDataFrame([(7, 1), (8, 2)], "device long, account long")
    claimed = spark.createDataFrame([("ann", 1, 1), ("cleo", 2, 1)], "name string, holders long, holder long")
    found = {r.event_id: r.name for r in streams.unreserved(events, accounts, claimed).collect()}
    assert found == {1: "Ann", 2: "", 3: "", 4: "Bob", 5: ""}


def test_empty_stream(stream):
    events = stream([]).withWatermark("ts", "1 hour").select("user_id", "event_id", F.unix_seconds("ts").alias("t"), "ts")
    assert runs.to_completion(state.rate_limited(events, 2, 3600), "append").count() == 0
