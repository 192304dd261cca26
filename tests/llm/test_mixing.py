import pytest
from pulsegrid.llm import bpe, mixing
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta "


def docs(spark):
    rows, i = [], 0
    for source, n, size in ((" Big ", 600, 3), ("small", 25, 2), ("SMALL", 15, 2), ("mid", 200, 9), (None, 50, 2)):
        for k in range(n):
            rows.append((i, WORDS * (size + k % 5), "en" if k % 3 else " DE ", source, "clash"))
            i += 1
    rows += [(i, None, "en", "big", ""), (i + 1, "", None, "big", ""), (i + 2, WORDS * 4000, "en", "big", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")


def plans(spark):
    rows = [(1, "big", 3.0, 2, 0.3), (1, "Small", 1.0, 4, 0.3), (1, "mid", 1.0, 2, 0.3), (2, "small", 1.0, 1, 0.5), (2, "big", 1.0, 3, 0.5), (3, "nowhere", 1.0, 5, 0.1), (3, "mid", 0.0, 5, 0.1), (4, "mid", 0.0, 1, 0.2), (5, "mid", 2.0, 3, 1.0)]
    return spark.createDataFrame(rows, "plan_id int, source string, weight double, max_repeats int, size_ratio double")


@pytest.fixture(scope="module")
def made(spark):
    tokens = mixing.document_tokens(docs(spark)).cache()
    calibrated = mixing.calibrate(plans(spark), mixing.cells_of(tokens)).cache()
    return tokens, calibrated


def test_found(spark, made):
    tokens, calibrated = made
    size, own = {}, {}
    for r in bpe.count_tokens(docs(spark), ["source"]).collect():
        size[0] = size.get(0, 0) + r.tokens
        own[(r.source or "").strip().lower()] = own.get((r.source or "").strip().lower(), 0) + r.tokens
    want, rows = set(), plans(spark).collect()
    for r in rows:
        total = sum(x.weight for x in rows if x.plan_id == r.plan_id)
        if total and r.max_repeats * own.get(r.source.lower(), 0) < r.weight / total * r.size_ratio * size[0]:
            want.add((r.plan_id, r.source.lower()))
    assert {tuple(r) for r in mixing.found(calibrated).collect()} == want and (3, "nowhere") in want


def test_mix(spark, made):
    tokens, calibrated = made
    drawn = mixing.draw(tokens, calibrated)
    repeats = {(r.plan_id, r.source.lower()): r.max_repeats for r in plans(spark).collect()}
    assert all(r.copies <= repeats[r.plan_id, r.source] and r.tokens > 0 for r in drawn.collect())
    for r in mixing.report(drawn, calibrated).collect():
        if r.plan_id == 4 or not r.target_share:
            assert r.actual_tokens == 0
        elif not r.short:
            assert abs(r.actual_tokens - r.target_tokens) <= 0.02 * r.target_tokens + 60, r
        else:
            have = tokens.where(F.col("source") == r.source).agg(F.sum("tokens")).first()[0] or 0
            assert r.actual_tokens == have * repeats[r.plan_id, r.source]


def test_empty(spark):
    none = mixing.document_tokens(docs(spark).where("false"))
    calibrated = mixing.calibrate(plans(spark), mixing.cells_of(none))
    assert mixing.draw(none, calibrated).count() == 0 and mixing.report(mixing.draw(none, calibrated), calibrated).count() == 9
    assert mixing.calibrate(plans(spark).where("false"), mixing.cells_of(none)).count() == 0


@pytest.mark.parametrize("filled", [0.3, 0.9, 0.999, 1.0, 1.5])
def test_source_totals_are_exact(filled):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = [(s, f"l{i}", f"t{j}", float(rng.integers(1, 10 ** int(rng.integers(1, 6))))) for s in ("a", "b") for i in range(15) for j in range(6)]
    pdf = pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])
    have = pdf.groupby("source")["tokens"].sum()
    # a is filled to the given part of its cap, b hardly.
    want = {"a": 2 * have["a"] * filled, "b": 0.1 * have["b"]}
    pdf = pdf.assign(max_repeats=2, size=sum(want.values()), share=pdf["source"].map(want) / sum(want.values()))
    got = mixing._rake(pdf)
    assert (got["weight"] <= 2).all() and (got["weight"] >= 0).all()
    for s, n in (got["weight"] * got["tokens"]).groupby(got["source"]).sum().items():
        assert n == pytest.approx(min(want[s], 2 * have[s]), rel=1e-9)


def test_marginals_as_asked(spark):
    """Shares of languages that a plan asks for are met by raking where caps allow it, and reported."""
    cells = spark.createDataFrame([(s, l, t, 1000, 10) for s in "ab" for l in ("en", "de") for t in ("c", "py")], "source string, lang string, topic string, tokens long, docs long")
    plans = spark.createDataFrame([(1, "A", 1.0, 5, 0.25), (1, " b ", 1.0, 5, 0.25)], "plan_id int, source string, weight double, max_repeats int, size_ratio double")
    asked = spark.createDataFrame([(1, "lang", "DE", 0.8), (1, "lang", "en", 0.2)], "plan_id int, dimension string, value string, share double")
    fitted = mixing.calibrate(plans, cells, asked)
    got = {r.lang: r.s for r in fitted.groupBy("lang").agg(F.sum(F.col("weight") * F.col("tokens")).alias("s")).collect()}
    assert abs(got["de"] - 1600) < 1 and abs(got["en"] - 400) < 1
    assert not fitted.where("short").count()
    short = mixing.calibrate(plans.withColumn("size_ratio", F.lit(6.0)), cells)
    assert mixing.found(short).count() == 2


@pytest.mark.parametrize("text, topic", [
    (None, "none"), ("message only", "none"), ("m\n\ndiff --git a/x.PY b/x.PY\n+a\ndiff --git a/d/y.c b/d/y.c\n+b\ndiff --git a/z.py b/z.py\n", "py"),
    ("diff --git a/Makefile b/Makefile\n", "other"), ("x" * 100_000 + "\ndiff --git a/q.rs b/q.rs\n", "rs"),
])
def test_topics_come_from_the_whole_text(spark, text, topic):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.topic_of(F.col("t")).alias("x")).first().x == topic
