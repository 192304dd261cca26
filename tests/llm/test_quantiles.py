import numpy as np
import pytest
from pulsegrid.llm import quantiles as Q
from pyspark.sql import functions as F

F_ALL = np.array([0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999])


def error(sketch, values):
    v = np.sort(values)
    got = sketch.quantiles(F_ALL)
    want = np.clip(np.ceil(F_ALL * len(v)), 1, len(v))
    low, high = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    off = np.where(want < low, low - want, np.where(want > high, want - high, 0))
    return off / np.minimum(want, len(v) - want + 1)


@pytest.mark.parametrize("shape", ["normal", "sorted", "reversed", "ties", "heavy"])
@pytest.mark.parametrize("parts", [1, 9])
def test_error_and_merging(shape, parts):
    rng = np.random.default_rng(parts)
    v = rng.normal(size=200_000)
    v = {"normal": v, "sorted": np.sort(v), "reversed": np.sort(v)[::-1], "ties": np.round(v), "heavy": np.exp(4 * v)}[shape]
    merged = Q.TwoEnded()
    for part in np.array_split(v, parts):
        s = Q.TwoEnded()
        for chunk in np.array_split(part, 7):
            s.add(chunk)
        merged.merge(Q.TwoEnded.from_bytes(s.to_bytes()))
    assert merged.high.n == len(v) and (merged.high.low, merged.high.high) == (v.min(), v.max())
    assert sum(len(x) * 2**h for h, x in enumerate(merged.high.levels)) == len(v)
    assert error(merged, v).max() <= Q.relative_error()
    assert len(merged.to_bytes()) < 80_000


def test_small_groups_are_exact():
    v = np.random.default_rng(0).normal(size=300)
    s = Q.TwoEnded()
    s.add(v)
    assert error(s, v).max() == 0 and s.low is None
    one = Q.TwoEnded()
    one.add(np.array([5.0]))
    assert one.quantiles(F_ALL).tolist() == [5.0] * 7


@pytest.mark.parametrize("held", [4_000_000, 1000])
def test_tables(spark, monkeypatch, held):
    monkeypatch.setattr(Q, "CHUNK", 5000)
    monkeypatch.setattr(Q, "HELD", held)
    rng = np.random.default_rng(2)
    n = 30_000
    rows = [(int(k) if k < 5 else None, int(d), float(x), "clash", 1) for k, d, x in zip(np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n)), rng.integers(1, 4, n), np.exp(rng.normal(size=n)))]
    rows += [(7, 1, None, "", 0), (7, 1, float("nan"), "", 0)]
    df = spark.createDataFrame(rows, "k int, day int, value double, sketch string, n int")
    by_day = Q.sketch(df, ["k", "day"])
    whole = Q.percentiles(Q.merge(by_day, ["k"]), ["k"], tuple(F_ALL)).collect()
    assert {r.k for r in whole} == {0, 1, 2, 3, 4, None}
    for r in whole:
        own = np.sort([x for k, _, x, *_ in rows if k == r.k and x is not None and x == x])
        assert r.n == len(own) and r.min_value == own[0] and r.max_value == own[-1]
        rank = np.searchsorted(own, r.percentiles, "right")
        want = np.ceil(F_ALL * len(own))
        assert (np.abs(rank - want) <= np.maximum(r.error_bound * np.minimum(want, len(own) - want + 1), 1e-9)).all()
    assert Q.percentiles(Q.sketch(df.where("false"), ["k"]), ["k"]).count() == 0
    assert Q.sketch(df.select(F.lit(1).alias("k"), "value"), ["k"]).count() == 1


def test_many_sketches_merge_in_two_steps(spark):
    """Sketches of many partitions merge in runs, within the bound, and coins differ between partitions."""
    rng = np.random.default_rng(8)
    v = rng.lognormal(0, 2, 60_000)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, value double").repartition(60)
    coins = {Q.Sketch(seed=s).coin >> 60 & 1 for s in range(20)}
    assert coins == {0, 1}
    parts = Q.sketch(df.withColumn("part", F.spark_partition_id()), ["g", "part"]).select("g", "sketch")
    for fan in (7, 1000):
        got = Q.percentiles(Q.merge(parts, ["g"], fan=fan), ["g"]).collect()
        assert len(got) == 1 and got[0].n == len(v)
        s = np.sort(v)
        for f, x in zip(Q.FRACTIONS, got[0].percentiles):
            rank = np.searchsorted(s, x, "right")
            assert abs(rank - np.ceil(f * len(v))) <= Q.relative_error() * min(np.ceil(f * len(v)), len(v) - np.ceil(f * len(v)) + 1) + 1
