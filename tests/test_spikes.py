import numpy as np
import pytest
from pulsegrid.operators import spikes as S

SCHEMA = "point_id long, file_id long, point_source_id int, point_index long, z double, intensity int, gps_time double, key int, own string, stretch string"


def source(rng, n, kind):
    t = np.arange(n)
    z = 300 + 0.2 * t + rng.normal(0, 0.3, n) if kind == "slope" else np.where(rng.random(n) < 0.5, 200 + rng.normal(0, 0.5, n), 200 + rng.uniform(3, 20, n)) if kind == "trees" else 50 + np.where(t > max(3 * n // 4, 60), 30.0, 0.0) + rng.normal(0, 0.2, n)
    return np.round(z, 3)


@pytest.mark.parametrize("kind", ["slope", "trees", "step"])
def test_outliers(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(20):
        n = int(rng.integers(100, 400))
        v = source(rng, n, kind)
        field = S.FIELDS[0]
        assert not S.implausible(v, field).any()
        size = {"slope": 9.0, "trees": 150.0, "step": 8.0}[kind]
        want = set()
        for at in (10, 25, 40):
            k = int(rng.integers(1, 4))
            v[at : at + k] += size * rng.choice([-1, 1])
            want |= set(range(at, at + k))
        v[n - 1] += size
        v[50] = 99999.0
        assert set(np.flatnonzero(S.implausible(v, field))) == want | {n - 1, 50}


def test_runs_and_limits():
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(1000, 100, 300))
    v[100:141] = 900.0
    v[200:212] = 1000.0
    v[5], v[7] = -1, 65536
    assert set(np.flatnonzero(S.implausible(v, S.FIELDS[1]))) == {5, 7, *range(100, 141)}
    t = 1e5 + np.cumsum(rng.exponential(0.001, 400))
    t[200:] += 0.03  # a gap between strips is no spike
    t[30] += 5
    t[60] = -1
    assert set(np.flatnonzero(S.implausible(t, S.FIELDS[2]))) == {30, 60}
    for short in ([], [1.0], [1.0, 5e6], [3.0] * 7, [3.0] * 30):
        a = np.array(short)
        assert S.implausible(a, S.FIELDS[0]).tolist() == [x > 9000 for x in short]


def table(spark, groups):
    rows, i = [], 0
    for (f, s), z in groups.items():
        for k, v in enumerate(z):
            rows.append((i, f, s, k, float(v) if v is not None else None, 100 + (i * 7) % 13, None, 1, "clash", "clash"))
            i += 1
    return rows


def test_sources(spark):
    rng = np.random.default_rng(5)
    groups = {(1, 1): source(rng, 300, "slope"), (1, 2): source(rng, 200, "trees"), (2, 1): source(rng, 90, "slope")}
    groups[1, 1][50] += 30
    groups[2, 1][20] -= 30
    rows = table(spark, groups)
    rows[60] = (*rows[60][:4], float("nan"), *rows[60][5:])
    extra = [(10_000, None, 1, 5, 1e6, 5, 1.0, 1, "", ""), (10_001, 1, None, 5, 1e6, 5, 1.0, 1, "", ""), (None, 1, 1, 5, 1e6, 5, 1.0, 1, "", "")]
    df = spark.createDataFrame(rows + rows[:40] + extra, SCHEMA)
    got = sorted(map(tuple, S.found(df).collect()))
    assert got == [(50, "z"), (300 + 200 + 20, "z")]
    assert S.found(df.where("false")).count() == 0


def test_long_sources_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    z = source(rng, 3000, "slope")
    want = []
    for at in (0, 499, 500, 501, 999, 1000, 1499, 2999):
        z[at] += 25
        want.append(at)
    z[1980:2025] = z[1980]
    want += range(1980, 2025)
    df = spark.createDataFrame(table(spark, {(1, 1): z, (1, 2): source(rng, 100, "step")}), SCHEMA)
    got = {r.point_id for r in S.found(df, stretch=500).where("field = 'z'").collect()}
    alone = {int(i) for i in np.flatnonzero(S.implausible(z, S.FIELDS[0]))}
    assert alone == got and set(want) - {499, 500, 501, 999, 1000} <= got


def test_infinite_readings(spark):
    z = source(np.random.default_rng(7), 100, "slope")
    z[20], z[40], z[60] = np.inf, -np.inf, np.nan
    df = spark.createDataFrame(table(spark, {(1, 1): z}), SCHEMA)
    assert sorted(map(tuple, S.found(df).collect())) == [(20, "z"), (40, "z")]


def test_fit_decides_where_lags_explain_the_series():
    """In an oscillation a reading inside the usual range is an outlier to the autoregression only."""
    rng = np.random.default_rng(11)
    t = np.arange(400)
    v = 100.0 + 10.0 * np.sin(2 * np.pi * t / 4.6) + rng.normal(0, 0.02, 400)
    v[150] = 100.0 if abs(v[150] - 100.0) > 3 else 106.0
    hit = np.flatnonzero(S.outliers(v, 9.0, 0.002))
    assert hit.tolist() == [150]
    level = np.array([np.median(v[max(0, i - 5) : i]) for i in range(1, 400)])
    assert abs(v[150] - level[149]) < 3 * np.median(np.abs(v[1:] - level))  # no median tells it


def test_level_shift_is_taken_out():
    rng = np.random.default_rng(12)
    v = rng.normal(0, 0.05, 300)
    v[100:] += 8.0
    v[200:] -= 5.0
    level = S._shifts(v, 0.5)
    assert np.allclose(level[[99, 100, 199, 200]], [0, 8, 8, 3], atol=0.3)
    v[99] += 3.0  # a spike just before a shift towards it
    v[250] -= 2.0
    assert np.flatnonzero(S.outliers(v, 9.0, 0.002)).tolist() == [99, 250]


def test_long_source_is_judged_as_a_whole(spark):
    """A calm stretch of a noisy source has its own scatter, but the source's decides."""
    rng = np.random.default_rng(13)
    n = 3000
    z = rng.normal(0, 1.0, n)
    z[2000:] *= 0.01
    z[2500] = 0.5  # far off for the stretch, ordinary for the source
    z[500] = 60.0
    rows = [(i, 1, i, 1, float(z[i])) for i in range(n)]
    p = spark.createDataFrame(rows, "point_id long, file_id long, point_index long, point_source_id int, z double")
    field = (S.Field("z", 9.0, 0.002, -500.0, 9000.0),)
    whole = {tuple(r) for r in S.readings(p, field).collect()}
    cut = {tuple(r) for r in S.readings(p, field, stretch=500).collect()}
    assert whole == cut == {(500, "z", "spike")}
