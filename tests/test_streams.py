"""Streams that fall silent: timers report what no further row would."""

import datetime
import itertools
import time

import numpy as np
import pytest

from skyquilt.streaming import jobs

T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)
COLUMNS = ["ts", "event_id", "lat", "lon", "gs_ms", "agl_m", "vs_ms"]
KIND = "aircraft long, ts timestamp, event_id long, lat double, lon double, gs_ms double, agl_m double, vs_ms double"


def fixes(spark, own):
    rows = [(a, T0 + datetime.timedelta(seconds=s), e, lat, lat, 0.0, 0.0, 0.0) for a, s, e, lat in own]
    return spark.createDataFrame(rows, KIND)


def run(spark, own, step, schema, silent, name):
    out = jobs.stateful(jobs.stream_of(fixes(spark, own), name), step, "aircraft long, event_id long, " + schema, COLUMNS, silent)
    return sorted(map(tuple, jobs.drained(out, name).collect()), key=str)


def test_a_stall_that_nothing_ends_is_reported(spark):
    own = [(1, 0, 10, 0.7), (1, 60, 11, 0.7), (2, 0, 20, 0.7), (2, 7200, 21, 0.7), (2, 7300, 22, 0.7)]
    got = run(spark, own, jobs.stalled, "silent_s double", jobs.still_silent, "test-stall")
    assert got == [(1, 11, None), (2, 21, 7200.0)]


def test_arrivals_here_and_elsewhere(spark):
    own = [(1, 0, 10, 0.7), (1, 5, 11, 0.2), (2, 0, 20, 0.7), (2, 11, 21, 0.8), (2, 12, 22, 0.1), (3, 0, 30, 0.9), (3, 4, 31, 0.9), (4, 100, 40, 0.9)]
    got = run(spark, own, jobs.arrived, "before long, how string", jobs.nothing_came, "test-arrival")
    assert got == [(1, 11, 1, "here"), (2, 21, 1, "elsewhere"), (3, 31, 2, "elsewhere")]


def test_a_silence_that_a_later_batch_ends(spark, tmp_path):
    """The first files' watermark is past the end of a wait that the second ones' fix ends; the next wait nothing ends."""
    fixes(spark, [(1, 0, 10, 0.7), (9, 9000, 90, 0.1)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    fixes(spark, [(1, 8995, 11, 0.7), (9, 20000, 91, 0.1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stateful(stream, jobs.stalled, "aircraft long, event_id long, silent_s double", COLUMNS, jobs.still_silent)
    got = sorted(map(tuple, jobs.drained(out, "test-late").collect()), key=str)
    assert got == [(1, 11, 8995.0), (1, 11, None), (9, 91, 11000.0)]


def test_cruise_ends_before_the_descent_is_seen():
    state: dict = {}
    agl = np.array([5_600.0, 6_000.0, 6_000.0, 6_000.0, 6_000.0])  # the second is 204 s before 13,000 ft: too late to begin
    rows = {"event_id": np.arange(5), "agl_m": agl, "vs_ms": np.array([0.0, -10.0, 0.0, -10.0, -12.0])}
    out = jobs.cruise(state, rows)
    assert (out["event_id"].tolist(), out["cruising"]) == ([2, 4], [True, False]) and state["on"] is False


@pytest.mark.parametrize("step", [jobs.jump, jobs.motion, jobs.cruise, jobs.stalled, jobs.arrived])
def test_batches_of_any_size_say_the_same(step):
    """A machine that takes its rows at once, one by one, or by uneven pieces, ends in the same state with the same rows out."""
    rng = np.random.default_rng(5)
    n = 400
    ts = np.datetime64("2024-05-01T12:00:00") + np.sort(rng.integers(0, 400_000_000_000, n)).astype("timedelta64[us]") * rng.integers(1, 5)
    rows = {
        "ts": ts, "event_id": np.arange(n), "lat": rng.uniform(0, 1, n), "lon": 0.6 + rng.uniform(0, 0.3, n), "gs_ms": rng.choice([0.0, 10.0, 90.0], n),
        "agl_m": rng.uniform(5_000, 6_000, n), "vs_ms": rng.choice([-20.0, 0.0, 5.0], n),
    }

    def run(edges):
        state, out = {}, []
        for a, b in itertools.pairwise([0, *edges, n]):
            got = step(state, {k: v[a:b] for k, v in rows.items()})
            out += list(zip(*(list(map(str, v)) for v in got.values())))
        return out, state

    whole = run([])
    assert whole[0] and run(range(1, n)) == whole == run([3, 4, 90, 91, 250])


def test_a_hot_key_costs_arrays():
    n = 1_000_000
    rows = {"ts": np.datetime64("2024-05-01") + np.arange(n).astype("timedelta64[s]"), "event_id": np.arange(n), "lat": np.zeros(n), "lon": np.arange(n) % 300 / 1_000, "gs_ms": np.zeros(n), "agl_m": np.full(n, 6e3), "vs_ms": np.zeros(n)}
    began = time.time()
    assert len(jobs.jump({}, rows)["km"]) == n // 300 and not jobs.motion({}, rows)["speed"] == [] and jobs.cruise({}, rows)["event_id"].tolist() == [0]
    assert time.time() - began < 20


def test_loads_as_sessions(spark):
    kind = "aircraft long, ts timestamp, event_id long, event_type string"
    own = [(1, 0, "view"), (1, 60, "view"), (1, 90, "error"), (1, 95, "error"), (1, 100, "view"), (1, 3700, "view"), (2, 0, "error"), (2, 5, "view"), (3, 20_000, "view")]
    rows = [(a, T0 + datetime.timedelta(seconds=s), i, e) for i, (a, s, e) in enumerate(own)]
    stream = jobs.stream_of(spark.createDataFrame(rows, kind), "test-loads")
    out = jobs.stateful(stream, jobs.load_session, "aircraft long, start timestamp, n long, how string", ["ts", "event_type"], jobs.no_more_loads)
    got = sorted((r.aircraft, int((r.start - T0).total_seconds()), r.n, r.how) for r in jobs.drained(out, "test-loads").collect())
    assert got == [(1, 0, 2, "mark"), (1, 100, 1, "silence"), (1, 3700, 1, "silence"), (2, 5, 1, "silence")]


def test_a_distance_between_two_millimetres_is_the_sqls(spark, tmp_path):
    """A fix 8.0865 km off its route: as a double that is a little less."""
    from skyquilt import catalog

    at = datetime.datetime(2024, 1, 11, 20, 30, 59)
    spark.createDataFrame([(136270, at, 1670, 13.83)], "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(16700, 16710).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["sm12_follow_route"](spark, str(tmp_path)).collect()
    assert [(r.event_id, r.leg, r.off_km, r.points) for r in got] == [(136270, 1, 8.086, 5)]


def followed(spark, path, fixes, keys):
    """Rows of sm12_follow_route and of its SQL, by event."""
    import duckdb

    from skyquilt import catalog

    at = datetime.datetime(2024, 1, 11, 20, 30, 59)
    spark.createDataFrame([(e, at, a, v) for e, a, v in fixes], "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    names = ["event_id", "aircraft", "leg", "off_km", "points", "end_lat", "end_lon"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['sm12_follow_route']}) ORDER BY event_id").fetchall()
    return sorted(map(tuple, catalog.queries()["sm12_follow_route"](spark, str(path)).select(*names).collect())), want


def test_a_track_at_the_very_limit_is_the_sqls(spark, tmp_path):
    """Fixes that fly at 100 degrees to a leg that goes due east: taken by way of the fix, its direction is a hair more."""
    fixes = [(2223050, 123, 100.0), (3681050, 204, 100.0), (9081050, 504, 100.0)]
    got, want = followed(spark, tmp_path, fixes, [a * 10 + k for _, a, _ in fixes for k in range(10)])
    assert got == want and [r[2] for r in got] == [2, 2, 2]


def test_a_leg_is_named_by_its_point(spark, tmp_path):
    """Routes that lack their first points, or one between."""
    keys = [16703, 16704, 16705, 16706, 1230, 1231, 1233, 1234, 1235, 1239]
    fixes = [(136270 + 6000 * k, 1670, 3.0) for k in range(3)] + [(n, 123, 3.0) for n in range(0, 6000, 7)]
    got, want = followed(spark, tmp_path, fixes, keys)
    assert got == want and {r[2] for r in got} >= {1, 3, 4}


def test_staged_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "shared_dir", lambda df, name: f"{tmp_path}/{name}")
    jobs.stream_of(spark.range(100, numPartitions=1).toDF("id"), "dealt")
    assert len(list(tmp_path.glob("stream-dealt/part-*"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_level_work_is_every_pair_in_reach(spark):
    """Across the date line, round a pole and along a path, against all pairs."""
    paths = [[(10.2, 179.8)], [(10.2, -179.9), (11.0, 179.3)], [(89.4, 20.0)], [(-87.0, -170.0), (-86.0, 178.0)], [(47.1, 8.2), (47.5, 9.6), (48.6, 9.9)]]
    near = [(t, u) for t in (*range(-90, -82), *range(6, 16), *range(43, 53), *range(85, 90)) for u in range(-180, 180) if abs(t) > 60 or abs(u) > 170 or 0 <= u < 20]
    index = spark.createDataFrame([(t, u, f"{t}/{u}", (t * 5 + u) % 7, t + 0.5, u + 0.5) for t, u in near], "tlat long, tlon long, name string, level int, ty double, tx double")
    fixes = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "aircraft long, event_id long, places array<struct<lat:double,lon:double>>")
    plan = jobs.level_work(fixes, index)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("array_min(transform(places") <= 3
    got = {(r.event_id, r.name): (r.want, r.km) for r in plan.collect()}
    want = {}
    for i, p in enumerate(paths):
        for t, u in near:
            km = min(float(jobs.km({"lat": np.array(a), "lon": np.array(b)}, {"lat": np.array(t + 0.5), "lon": np.array(u + 0.5)})) for a, b in p)
            level = next((n for n, r in enumerate((13.6, 23.7, 42.9, 81.4)) if km <= r * 1.11), 4)
            if km <= jobs.REACH_KM and level < (t * 5 + u) % 7:
                want[i, f"{t}/{u}"] = (level, round(km, 3))
    assert len(want) > 500 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.0011 for k in want)


def test_a_group_of_aircraft_is_one_call():
    """Aircraft share a key, a state and a frame of what comes out; each is on its own, and the timer is the earliest."""
    import pandas as pd

    class State:
        exists, hasTimedOut, text, due = False, False, None, None
        get = property(lambda self: (self.text,))

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.exists, (self.text,) = True, value

        def setTimeoutTimestamp(self, due):
            self.due = due

    run = jobs.by_aircraft(jobs.stalled, "aircraft long, event_id long, silent_s double", COLUMNS, jobs.still_silent)
    rows = [(a, T0 + datetime.timedelta(seconds=s), e, 0.0, 0.0, 0.0, 0.0, 0.0) for a, s, e in ((2, 9000, 21), (1, 0, 10), (2, 0, 20), (1, 4000, 11), (3, 50, 30))]
    frame, state = pd.DataFrame(rows, columns=["aircraft", *COLUMNS]), State()
    out = pd.concat(run((0,), iter([frame]), state))
    assert sorted(map(tuple, out.to_numpy().tolist())) == [(1, 11, 4000.0), (2, 21, 9000.0)]
    since = int(frame["ts"].iloc[4].value // 10**6) + jobs.STALL_MS
    assert state.due == since
