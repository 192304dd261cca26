import numpy as np
import pytest
from pulsegrid.llm import neighbours as N
from pyspark.sql import functions as F


def brute(ids, v, k):
    out = {}
    for i, x in zip(ids, v):
        d = ((v - x) ** 2).sum(axis=1)
        out[i] = [j for _, j in sorted((dd, j) for dd, j in zip(d, ids) if j != i)[:k]]
    return out


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in row], "clash", 1) for i, row in zip(ids, v)], "id long, vec array<double>, leaf string, asks int")


def found(df, k, **o):
    out = {}
    for r in N.nearest(df, k, **o).orderBy("id", "distance", "neighbour").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("dims", [3, 16, 64])
@pytest.mark.parametrize("crowded", [4096, 150])
def test_recall_by_dimension(spark, monkeypatch, dims, crowded):
    """Against brute force on id % 50 = 0, with and without leaves that are split once more."""
    monkeypatch.setattr(N, "LEAF", 64)
    monkeypatch.setattr(N, "SAMPLE", 1500)
    monkeypatch.setattr(N, "CROWDED", crowded)
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(5000, dims)) @ rng.normal(size=(dims, dims))
    df = table(spark, np.arange(5000), v)
    assert N.recall(N.nearest(df, 4, every=50), df, 4) >= 0.9


def test_exact(spark, monkeypatch):
    """All vectors in blocks of queries give the true neighbours."""
    monkeypatch.setattr(N, "BLOCK", 50)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 5, (300, 3)).astype(float)
    ids = rng.permutation(900)[:300]
    df = table(spark, ids, v)
    assert found(df, 4, exact=True) == brute(ids.tolist(), v, 4)
    assert N.nearest(df.where("false"), 4, exact=True).count() == 0


def test_rank_breaks_ties_by_id():
    v = np.array([[0.0], [1.0], [-1.0], [1.0], [-1.0], [2.0]])
    ids = np.array([5, 9, 3, 1, 7, 2])
    d, i = N.rank(v[:1], ids[:1], v, ids, 3)
    assert i.tolist() == [[1, 3, 7]] and d.tolist() == [[1.0, 1.0, 1.0]]
    d, i = N.rank(v[:1], ids[:1], v[:2], ids[:2], 3)
    assert i.tolist() == [[9, -1, -1]]


@pytest.mark.parametrize("k", [1, 4])
def test_exact_with_copies(spark, k):
    rng = np.random.default_rng(k)
    v = rng.integers(0, 6, (400, 3)).astype(float)  # many copies and ties
    v[:60] = 2.0
    ids = rng.permutation(1000)[:400]
    df = table(spark, ids, v)
    df = df.union(df.limit(30)).union(spark.createDataFrame([(5000, None, "", 0), (5001, [1.0, None, 2.0], "", 0), (5002, [1.0, float("nan"), 2.0], "", 0), (None, [1.0, 1.0, 1.0], "", 0)], df.schema))
    assert found(df, k) == brute(ids.tolist(), v, k)


def test_many(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 64)
    monkeypatch.setattr(N, "SAMPLE", 2000)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 3)) * [50, 50, 3]
    ids = np.arange(6000)
    df = table(spark, ids, v)
    got = found(df, 4, every=50)
    assert set(got) == set(range(0, 6000, 50))
    hit = [len(set(n) & set(ids[np.argsort(((v - v[i]) ** 2).sum(axis=1))[1:5]].tolist())) / 4 for i, n in got.items()]
    assert np.mean(hit) > 0.97


def test_few(spark):
    df = table(spark, [1, 2, 3], np.array([[0.0, 0, 0], [1, 0, 0], [5, 0, 0]]))
    assert found(df, 4) == {1: [2, 3], 2: [1, 3], 3: [2, 1]}
    assert found(df.where("id = 1"), 4) == {} and found(df.where("false"), 4) == {}
    assert {tuple(r) for r in N.pairs(N.nearest(df, 1)).collect()} == {(1, 2), (2, 3)}
    assert df.select(F.col("id")).count() == 3
