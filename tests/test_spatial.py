import numpy as np
import pytest
from pulsegrid.operators import spatial as S
from pyspark.sql import functions as F


def one(px, py, xs, ys, algorithm):
    """Scalar versions, written apart from the arrays."""
    n, wind, odd = len(xs), 0, False
    for i in range(n):
        x1, y1, x2, y2 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        if algorithm == 1 and (x2, y2) == (px, py):
            return True
        if (y1 > py) == (y2 > py):
            continue
        side = (py - y1) * (x2 - x1) - (px - x1) * (y2 - y1)
        if algorithm == 1 and side == 0:
            return True
        if algorithm == 2:
            odd ^= px < (x1 - x2) * (py - y2) / (y1 - y2) + x2
        elif y2 > y1:
            wind += side > 0
        else:
            wind -= side < 0
    return bool(odd) if algorithm == 2 else wind != 0


SQUARE = ([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])
# Point, then inside by winding, with edges, by ray.
TABLE = [
    ((0.5, 0.5), (1, 1, 1)), ((0.0, 0.5), (1, 1, 1)), ((0.5, 0.0), (1, 1, 1)), ((0.0, 0.0), (1, 1, 1)), ((1.0, 0.5), (0, 1, 0)), ((0.5, 1.0), (0, 0, 0)),
    ((1.0, 0.0), (0, 1, 0)), ((0.0, 1.0), (0, 1, 0)), ((1.0, 1.0), (0, 1, 0)), ((float("nan"), 0.5), (0, 0, 0)), ((0.5, float("nan")), (0, 0, 0)),
]


@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("point,want", TABLE)
def test_square(point, want, turn):
    xs, ys = S.ring(SQUARE[0][::turn], SQUARE[1][::turn])
    assert [int(S.inside(np.array([point[0]]), np.array([point[1]]), xs, ys, a)[0]) for a in (0, 1, 2)] == list(want)


def test_wound_twice_and_closed():
    xs, ys = S.ring(SQUARE[0] * 2, SQUARE[1] * 2)
    p = np.array([0.5]), np.array([0.5])
    assert S.inside(*p, xs, ys, 0)[0] and S.inside(*p, xs, ys, 1)[0] and not S.inside(*p, xs, ys, 2)[0]
    xs, ys = S.ring([*SQUARE[0], 0.0], [*SQUARE[1], 0.0])
    assert all(S.inside(*p, xs, ys, a)[0] for a in (0, 1, 2))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 60])
@pytest.mark.parametrize("algorithm", [0, 1, 2, 9])
def test_random_rings(n, algorithm, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 500)
    rng = np.random.default_rng(n)
    xs, ys = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
    px, py = rng.integers(-1, 13, 800) / 1.0, rng.integers(-1, 13, 800) / 1.0
    assert S.inside(px, py, xs, ys, algorithm).tolist() == [one(a, b, xs, ys, algorithm if algorithm < 3 else 0) for a, b in zip(px, py)]


def test_arguments():
    for bad in (([], []), ([1.0], [1.0, 2.0]), (["a"], ["b"]), ([[1.0]], [[1.0]]), ([1j], [1j])):
        with pytest.raises(ValueError):
            S.ring(*bad)


def test_columns(spark):
    df = spark.range(2000).select(F.col("id"), (F.rand(1) * 3 - 1).alias("x"), (F.rand(2) * 3 - 1).alias("y"))
    df = df.union(spark.createDataFrame([(-1, None, 0.5), (-2, float("nan"), 0.5)], "id long, x double, y double")).withColumn("inside", F.lit("clash"))
    rows = df.collect()
    want = {r.id for r in rows if r.x is not None and one(r.x, r.y, *SQUARE, 0)}
    assert {r.id for r in S.select_inside(df, *SQUARE).collect()} == want
    assert {r.id for r in S.select_outside(df, *SQUARE).collect()} == {r.id for r in rows} - want
    assert {r.id for r in S.winding_by_edges(df, "id", *SQUARE).collect()} == want
    polys = {3: SQUARE, 1: ([0.5, 2.0, 2.0, 0.5], [0.5, 0.5, 2.0, 2.0])}
    got = {r.id: r.c for r in df.select("id", S.containing("x", "y", polys).alias("c")).collect()}
    assert all((3 in got[i]) == (i in want) and got[i] == sorted(got[i]) for i in got)
    assert S.select_inside(df.limit(0), *SQUARE).count() == 0
    single = df.select(S.is_inside("x", "y", *SQUARE, single=True).alias("i")).where("i").count()
    assert single == len(want)


def test_circle():
    xs, ys = S.circle(5.0, 6.0, 0.2, 3960)
    assert len(xs) == 3960 and np.allclose(np.hypot(xs - 5, ys - 6), 0.2) and abs(xs[-1] - 5) < 1e-9 and abs(ys[-1] - 6.2) < 1e-9
