import datetime as dt

import numpy as np

from catalith.operators import spikes as S

LIMITS = [("celsius", -89.0, 75.0), ("count", 0.0, 100000.0)]


def series(n, seed=0, level=20.0, wave=3.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return level + wave * np.sin(t / 144 * 2 * np.pi) + rng.normal(0, 0.2, n)


def frame(spark, rows):
    return spark.createDataFrame(rows, "reading_id bigint, sensor_id string, reading double, unit string, timestamp string, location string, received_at timestamp")


def run(spark, rows, **kw):
    limits = spark.createDataFrame(LIMITS, "unit string, min_reading double, max_reading double")
    return {(r.reading_id, r.reason) for r in S.implausible_readings(frame(spark, rows), limits, **kw).collect()}


def as_rows(values, sensor="s", unit="celsius", start=0, base=dt.datetime(2024, 1, 1)):
    return [(start + i, sensor, None if v is None else float(v), unit, (base + dt.timedelta(minutes=10 * i)).strftime("%Y-%m-%dT%H:%M:%SZ"), None, base) for i, v in enumerate(values)]


def test_notations(spark):
    texts = ["2024-01-03T02:00:00+02:00", "2024-01-03 00:00:00", "1704240000000", "1704240000", "2024-01-03T00:00:00.000+00:00", "2024-01-03T00:00:00Z", "2024-01-03T02:00:00+0200", None, "", "soon"]
    out = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(S.instant(__import__("pyspark.sql.functions", fromlist=["col"]).col("x")).alias("t")).collect()]
    assert out[:7] == [1704240000000000] * 7 and out[7:] == [None] * 3


def test_spikes_steps_and_stuck(spark):
    v = series(900)
    v[100] += 9
    v[300:302] -= 8
    v[400:405] += 9  # five in a row are no spike
    v[600:] += 10  # a lasting change of level is none
    v[700:720] = v[700]
    v[800:811] = v[800]  # eleven equal readings
    v = list(v)
    v[500] = 99.0
    v[501] = float("nan")
    v[850] = None
    rows = as_rows(v)
    rows += [rows[100], rows[705]]  # delivered twice
    rows.append((9000, "s", 500.0, "celsius", None, None, dt.datetime(2024, 1, 1)))
    want = {(100, "spike"), (300, "spike"), (301, "spike"), (500, "range"), (501, "range")} | {(i, "stuck") for i in range(700, 720)}
    assert run(spark, rows) == want
    assert run(spark, rows, piece=200, margin=64) == want  # the same in pieces


def test_resting_sensors_units_and_empty(spark):
    quiet = [0.0] * 200
    quiet[50], quiet[120], quiet[121] = 700.0, 9.0, 3.0
    rows = as_rows(quiet, "door", "count")
    missing = as_rows(series(60, 3), "m", "Celsius ", 5000)
    missing[10] = (*missing[10][:2], 80.0, None, *missing[10][4:])
    unknown = as_rows([1e6, 2e6, 1.5e6], "u", "kelvin", 7000)
    assert run(spark, rows + missing + unknown) == {(50, "spike"), (5010, "range")}
    assert run(spark, []) == set()


def daily(n=720, seed=1):
    """Hourly readings with the same sharp profile every day: no level of the readings around explains them."""
    rng = np.random.default_rng(seed)
    profile = np.array([0, 9, -6, 12, -11, 5, 14, -3, 8, -13, 2, 11, -7, 6, -9, 13, -4, 10, -12, 3, 7, -8, 1, -5], float)
    day = np.arange(n) // 24
    return 20 + profile[np.arange(n) % 24] * (1 + 0.1 * np.sin(day)) + rng.normal(0, 0.2, n)


def hourly(values):
    base = dt.datetime(2024, 1, 1)
    return [(i, "s", float(v), "celsius", (base + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%SZ"), None, base) for i, v in enumerate(values)]


def test_the_low_rank_part_decides(spark, monkeypatch):
    v = daily()
    planted = [100, 311, 312, 500]
    v[planted] += [5, -6, -6, 7]
    assert run(spark, hourly(v)) == {(i, "spike") for i in planted}
    t = np.arange(len(v), dtype=np.int64) * 3_600_000_000
    p = lambda: S.Piece(np.arange(len(v)), t, v, np.ones(len(v), bool), np.zeros(len(v), np.int16), [(-89.0, 75.0, False)], (0, int(t[-1]), len(t)))
    assert np.flatnonzero(S.whole(p())).tolist() == planted
    monkeypatch.setattr(S, "profile_residual", lambda t, deviation, *rest: deviation.copy())
    assert np.flatnonzero(S.whole(p())).tolist() == []  # without it the profile hides them all
    monkeypatch.undo()
    monkeypatch.setattr(S, "low_rank", lambda matrix, *rest: np.zeros_like(matrix))
    assert np.flatnonzero(S.whole(p())).tolist() == []


def test_a_cut_sensor_equals_the_whole(spark):
    v = series(4000, 7)
    rng = np.random.default_rng(8)
    v[rng.choice(4000, 40, replace=False)] += rng.choice([-1, 1], 40) * rng.uniform(2, 12, 40)
    v[995:1010] = v[995]  # a stuck stretch over a cut
    v[2500:] += 4
    rows = as_rows(v)
    rows = [(*r[:3], None if i % 900 > 700 else r[3], *r[4:]) for i, r in enumerate(rows)] + as_rows(series(100, 9), "other", "kelvin", 9000)
    whole = run(spark, rows)
    assert {k for _, k in whole} == {"spike", "stuck"}
    assert run(spark, rows, piece=500) == whole
    assert run(spark, rows, piece=1000) == whole


def test_where_changes_are_rare_nothing_is_stuck(spark):
    v = np.repeat(series(60, 10), 40)[:2000]  # values that usually stay for 40 readings
    rows = as_rows(v)
    assert run(spark, rows) == run(spark, rows, piece=400)
