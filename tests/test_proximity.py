import numpy as np
import pytest
from pulsegrid.operators import proximity as P
from pyspark.sql import functions as F

from .test_spatial import one

SCHEMA = "point_id long, x double, y double, cx int, own string, parts int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)


def brute(rows, radius):
    pts = {i: (round(x * 1000), round(y * 1000)) for i, x, y in rows if i is not None and x is not None and y is not None and np.isfinite(x) and np.isfinite(y)}
    ids = sorted(pts)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= radius**2}


@pytest.mark.parametrize("hot", [20_000, 15])
def test_near_pairs(spark, hot):
    rng = np.random.default_rng(hot)
    rows = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-3, 3, (300, 2)), 3))]
    rows += [(1000 + i, 1.0, 1.0) for i in range(60)]  # copies at one place
    rows += [(2000, 0.0, 0.0), (2001, 0.3, 0.0), (2002, 0.0, -0.301), (2003, -0.212, 0.212)]
    rows += rows[:50]  # delivered twice
    rows += [(None, 1.0, 1.0), (3000, None, 1.0), (3001, float("nan"), 1.0), (3002, 1.0, float("inf")), (3003, 1e300, 0.0)]
    got = P.near_pairs(table(spark, rows), 300.5, hot=hot).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute([r for r in rows if r[0] != 3003], 300.5)


def test_empty(spark):
    none = table(spark, []).where("false")
    polys = spark.createDataFrame([], "poly_id long, seq int, x double, y double")
    assert P.found(none, polys).count() == 0
    assert P.found(table(spark, [(1, 0.0, 0.0)]), polys).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_regions(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(3)
    rings = {k: np.round(rng.uniform(0, 40, (n, 2)), 3) + 0.0005 for k, n in enumerate((3, 4, 9, 30), 1)}
    rings[5] = np.array([[0.0, 0.0], [4000, 0], [4000, 4000], [0, 4000]]) - 1000.25
    square = np.array([[1.0, 1], [5, 1], [5, 5], [1, 5]]) + 0.0005
    rings[6], rings[7], rings[8] = np.vstack([square, square]), np.vstack([square, square[:1]]), square[::-1]
    rings = {k: np.round(v, 3) for k, v in rings.items()}
    rows = [(k, i, float(x), float(y)) for k, v in rings.items() for i, (x, y) in enumerate(v)]
    rows += rows[:7]
    rows += [(20, 0, 1.0, 1.0), (20, 1, 2.0, 2.0), (21, 0, 1.0, 1.0), (22, 0, 0.0, 0.0), (22, 1, 9.0, float("nan")), (22, 2, 9.0, 9.0), (23, 0, None, 1.0), (23, 1, 2.0, 3.0), (23, 2, 2.0, 9.0), (None, 1, 1.0, 1.0)]
    polys = spark.createDataFrame(rows, "poly_id long, seq int, x double, y double").withColumn("level", F.lit("clash"))
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-2, 42, (500, 2)), 3))]
    got = P.points_in_polygons(table(spark, pts + pts[:40] + [(900, None, 1.0)]), polys).collect()
    mm = lambda v: np.round(v * 1000)
    want = {(k, i) for k, v in rings.items() for i, x, y in pts if one(mm(x), mm(y), mm(v[:, 0]).tolist(), mm(v[:, 1]).tolist(), 0)}
    assert sorted(map(tuple, got)) == sorted(want)


def test_split_tiles_hold_all_points(spark):
    """A third of all points in one crowded cell gives the same pairs, however it is split."""
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(0, 30, (600, 2)), 3))]
    rows += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(5, 5.8, (300, 2)), 3))]
    got = [{tuple(r) for r in P.near_pairs(table(spark, rows), 300.5, hot=h).collect()} for h in (20_000, 100, 7)]
    assert got[0] == brute(rows, 300.5) and got[1] == got[0] and got[2] == got[0]


@pytest.mark.parametrize("hot", [20_000, 10])
def test_near_on_earth(spark, hot):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 250), rng.uniform(-90, 90, 250)))]
    rows += [(300 + i, 10.0 + float(a), 50.0 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 3, (80, 2)))]
    rows += [(400, 179.9, 0.0), (401, -179.9, 0.0), (402, 0.0, 90.0), (403, 90.0, 89.9), (404, -170.0, 89.0)]
    rows += rows[:20]
    want = set()
    pts = {i: (np.radians(a), np.radians(b)) for i, a, b in rows}
    for i, (a, b) in pts.items():
        for j, (c, d) in pts.items():
            if i < j:
                h = np.sin((b - d) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((a - c) / 2) ** 2
                if 2 * P.EARTH_M * np.arcsin(min(np.sqrt(h), 1)) <= 500_000:
                    want.add((i, j))
    bad = [(500, None, 1.0), (501, float("nan"), 1.0), (502, 1.0, 91.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + bad, "id long, lon double, lat double").withColumn("x", F.lit("clash")).withColumn("own", F.lit(1))
    got = P.near_on_earth(df, 500_000.0, hot=hot).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {(400, 401), (402, 403), (402, 404)} <= want
    assert P.near_on_earth(df.where("false"), 10.0).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("algorithm", [0, 1, 2, 5])
def test_regions_by_all_algorithms(spark, monkeypatch, limit, algorithm):
    """A polygon that holds a third of the points and small ones, with and without broadcasting, points on edges and
    vertices and repeated rows included."""
    from pulsegrid.operators import spatial

    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(P, "HOT_POLYGON", 50)
    rng = np.random.default_rng(4)
    n = 600
    x, y = rng.integers(0, 60, n).astype(float), rng.integers(0, 60, n).astype(float)
    rings = {1: ([0.0, 35, 35, 0], [0.0, 0, 35, 35]), 2: ([40.0, 50, 45] * 2, [40.0, 40, 55] * 2), 3: ([5.0, 20, 5, 20], [50.0, 50, 58, 58]), 4: ([10.0, 30, 50, 30], [30.0, 10, 30, 50])}
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    p = spark.createDataFrame(rows + rows[:50], "point_id long, x double, y double")
    g = spark.createDataFrame([(k, i, float(a), float(b)) for k, (xs, ys) in rings.items() for i, (a, b) in enumerate(zip(xs, ys))], "poly_id long, seq int, x double, y double")
    got = sorted(map(tuple, P.points_in_polygons(p, g, algorithm=algorithm).collect()))
    want = sorted((k, int(i)) for k, (xs, ys) in rings.items() for i in np.flatnonzero(spatial.inside(x, y, np.array(xs), np.array(ys), algorithm)))
    assert got == want
