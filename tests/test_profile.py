import numpy as np
import pytest
from pulsegrid.operators import profile as P
from pyspark.sql import functions as F


def counts(spark, rows, low=0, high=100):
    df = spark.createDataFrame(rows, "load_id int, v double, value string, n int")
    return P.union_counts([P.value_counts(df, [P.ColumnSpec("v", F.col("v"), ~F.col("v").between(low, high), F.col("v"))])])


def brute(rows, limits=P.Limits(), low=0, high=100):
    out = set()
    clean = [(a, None if v is None or v != v else v) for a, v, *_ in rows]
    for load in {a for a, _ in clean} - {None}:
        own, rest = [v for a, v in clean if a == load], [v for a, v in clean if a != load]
        if not rest:
            continue
        share = lambda x: sum(v is None for v in x) / len(x)
        if share(own) - share(rest) > limits.nulls:
            out.add((load, "v", "nulls"))
        a, b = [v for v in own if v is not None], [v for v in rest if v is not None]
        if not a or not b:
            continue
        bad = lambda x: sum(not low <= v <= high for v in x) / len(x)
        mode = lambda x: max(np.unique(x, return_counts=True)[1]) / len(x)
        if bad(a) - bad(b) > limits.invalid:
            out.add((load, "v", "range"))
        if mode(a) - mode(b) > limits.repeat:
            out.add((load, "v", "repeat"))
        grid = np.unique(a + b)
        gap = max(abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))
        if gap > limits.shift:
            out.add((load, "v", "shift"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_issues(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for load in range(1, 7):
        v = rng.integers(0, 60, 120).astype(float) + rng.integers(0, 2) * 0.5
        if load == 2:
            v[rng.random(120) < 0.2] = np.nan
        if load == 3:
            v += 35
        if load == 4:
            v[rng.random(120) < 0.4] = 7
        if load == 5:
            v[:9] = 1000
        rows += [(load, float(x), "clash", 1) for x in v]
    rows += [(None, 3.0, None, None)] * 30 + [(6, None, None, None)] * 3 + rows[:50]
    profiled = P.profile(counts(spark, rows))
    assert {tuple(r) for r in P.issues(profiled).where("issue <> 'pattern'").collect()} == brute(rows)
    one = {r.load_id: r for r in profiled.collect()}
    own = [v for a, v, *_ in rows if a == 3]
    assert one[3].rows == len(own) and one[3].distinct_values == len(set(own)) and one[3].max_value == max(own)


def test_small_tables(spark):
    assert P.profile(counts(spark, [])).count() == 0
    one = P.profile(counts(spark, [(1, 5.0, "", 0), (1, None, "", 0)])).collect()
    assert len(one) == 1 and one[0].null_share == 0.5 and one[0].others_null_share is None and one[0].gap is None
    assert P.issues(P.profile(counts(spark, [(1, None, "", 0), (2, None, "", 0)]))).count() == 0


def test_expressions(spark):
    rows = [(1, f"AB-{i:04d}") for i in range(200)] + [(2, f"v{i % 9}.{i}") for i in range(150)] + [(2, "?? broken *"), (2, "x" * 5000), (1, ""), (1, None)]
    df = spark.createDataFrame(rows, "load_id int, s string").withColumn("h", F.hash("s").cast("double"))
    c = P.union_counts([P.value_counts(df, [P.ColumnSpec("s", F.col("h"), F.lit(False), F.col("s"))])])
    got = {r.regex for r in P.induce_expressions(c).collect()}
    assert r"\p{Lu}{2}\-\d{4}" in got
    import regex

    fits = lambda s: any(regex.fullmatch(g, s) for g in got)
    assert all(fits(s) for _, s in rows[:350]) and not fits("?? broken *") and not fits("")
    # Every value is described or counted as nonconforming.
    p = {r.load_id: r for r in P.profile(c).collect()}
    odd = sum(s is not None and not fits(s) for a, s in rows if a == 2)
    assert abs(p[2].nonconforming_share - odd / 152) < 1e-12


def test_mode_of_others_among_values_a_load_lacks(spark):
    """Load 1 has all top values to itself; what it lacks is found below them, however few are looked at first."""
    rows = [(1, "c", float(k), 1000 + k) for k in range(60)] + [(2, "c", 500.0, 10), (2, "c", 3.0, 1), (None, "c", 501.0, 12), (3, "c", 500.0, 5)]
    counts = spark.createDataFrame(rows, "load_id int, column_name string, value double, n long")
    for top in (2, 16, 256):
        got = {r.load_id: r.others_mode for r in P._mode_of_others(counts, top).collect()}
        assert got == {1: 15, 2: 1059, 3: 1059}


def test_numbers_share_one_expression(spark):
    import re

    rng = np.random.default_rng(3)
    texts = {f"{x:.3f}" for x in rng.normal(0, 300, 500)} | {str(int(x)) for x in rng.integers(-5000, 5000, 300)}
    counts = spark.createDataFrame([("c", x) for x in sorted(texts)] + [("c", "n/a ??"), ("d", "AB-12"), *[("d", f"XY-{k}") for k in range(10, 99)]], "column_name string, text string")
    got = P.induce_expressions(counts).collect()
    of = {c: {r.regex for r in got if r.column_name == c} for c in "cd"}
    assert len(of["c"]) == 1 and all(re.fullmatch(next(iter(of["c"])), x) for x in texts)
    assert len(of["d"]) == 1 and not re.fullmatch(next(iter(of["c"])), "n/a ??")
