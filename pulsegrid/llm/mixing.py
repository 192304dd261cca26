"""Mixes of sources by target shares of the size in tokens.

Tokens are counted once for every document and summed to cells of (source, language, topic); the topic is the kind of
file that most of a commit's changes touch. For each plan the cells' token weights are raked by iterative proportional
fitting: the source marginals are the plan's shares of its size, cut to what max_repeats allows, the language and topic
marginals are those given, else half the corpus's own and half those of the plan's sources weighted by their shares.
The fitted weight of a cell is the expected number of times that each of its documents is used; a source that raking
leaves below its share is short. Documents are then drawn systematically, in order of size, so that each is used the
whole part of its weight or once more and the drawn size stays near the target.

Sources, languages and topics compare trimmed and lower-cased; documents without source belong to no source of
a plan but count in the size of all documents. Null and empty texts have no tokens and are never drawn. A plan
with no positive weight has no shares. Cells are few (categories, not documents); each plan is fitted in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, fitting
from . import bpe


def plain(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")))


def topic_of(text: Column) -> Column:
    """The ending of most file names in a commit's diff (of equally many the last in order), over the whole text; none
    without a diff, other for files without an ending."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^diff --git (?:.*[^.\s/]\.([A-Za-z0-9_+]{1,12})|.*)$"), F.lit(1))
    ends = F.transform(names, lambda n: F.when(n == "", "other").otherwise(F.lower(n)))
    best = F.array_max(F.transform(F.array_distinct(ends), lambda e: F.struct(F.size(F.filter(ends, lambda o: o == e)).alias("n"), e.alias("e"))))
    return F.coalesce(best["e"], F.lit("none"))


def document_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every document."""
    d = docs.select("doc_id", plain("source").alias("source"), F.coalesce(plain("lang"), F.lit("")).alias("lang"), topic_of(F.col("text")).alias("topic"), "text")
    return bpe.count_tokens(d, ["doc_id", "source", "lang", "topic"], path=path)


def cells_of(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def plan_targets(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """(plan_id, source, share, max_repeats, size, tokens): each source of each plan with what it has."""
    p = plans.select("plan_id", plain("source").alias("source"), "weight", "max_repeats", "size_ratio").where("plan_id is not null and source is not null")
    p = p.groupBy("plan_id", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    p = p.withColumn("share", F.col("weight") / F.expr("nullif(sum(weight) over (partition by plan_id), 0)"))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    have = cells.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    p = p.join(have, "source", "left")
    return p.join(total, F.lit(True)).select("plan_id", "source", "share", "max_repeats", (F.col("size_ratio") * F.col("all_tokens")).alias("size"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


ROUNDS = 50
STARTS = 32
LARGE = 0.01
#: Documents of a part in which weights are summed up.
PART_ROWS = 20_000
#: Rows up to which tables of categories are sent to all tasks.
GROUPS = 100_000


def _exact(w: np.ndarray, have: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """One source's weights times the one factor, cut off at the caps, with which they make up the target."""
    if target >= (cap * have).sum() * (1 - 1e-12):
        return cap
    use = np.flatnonzero((w > 0) & (have > 0))
    if target <= 0 or not len(use):
        return w
    use = use[np.argsort(cap[use] / w[use], kind="stable")]  # the order in which cells reach their cap
    at = cap[use] / w[use]
    full = np.r_[0.0, np.cumsum(cap[use] * have[use])[:-1]]
    free = np.cumsum((w[use] * have[use])[::-1])[::-1]
    fits = np.flatnonzero((target - full) / free <= at)
    factor = (target - full[fits[0]]) / free[fits[0]] if len(fits) else at[-1]
    return np.minimum(w * factor, cap)


def _rake(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fits one plan's cells; adds weight, the expected uses of a document of the cell."""
    have = pdf["tokens"].to_numpy(float)
    cap = pdf["max_repeats"].to_numpy(float)
    code = {c: pd.factorize(pdf[c].fillna(""))[0] for c in ("source", "lang", "topic")}
    share = pdf["share"].fillna(0).to_numpy(float)
    n_src = code["source"].max() + 1
    supply = np.bincount(code["source"], have, n_src)
    target = np.zeros(n_src)
    np.maximum.at(target, code["source"], share * pdf["size"].to_numpy(float))
    most = np.zeros(n_src)
    np.maximum.at(most, code["source"], cap)
    target = np.minimum(target, most * supply)
    ratio = np.divide(target, supply, out=np.zeros(n_src), where=supply > 0)
    w = ratio[code["source"]]
    # Language and topic marginals: those given, else of the plan's sources in proportion to their targets and of the corpus.
    wanted = {c: np.bincount(code[c], w * have) for c in ("lang", "topic")}
    size = np.bincount(code["source"], w * have, n_src)
    corpus = {c: np.bincount(code[c], have) for c in ("lang", "topic")}
    for c in wanted:
        total = corpus[c].sum()
        even = corpus[c] / total * size.sum() if total else corpus[c]
        wanted[c] = 0.5 * wanted[c] + 0.5 * even
        asked = pdf[f"{c}_share"].to_numpy(float) if f"{c}_share" in pdf else np.empty(0)
        if np.isfinite(asked).any():
            given = np.zeros(len(wanted[c]))
            np.maximum.at(given, code[c], np.nan_to_num(asked))
            wanted[c] = given / max(given.sum(), 1e-300) * size.sum()
    for _ in range(ROUNDS):
        old = w
        for c in ("lang", "topic"):
            now = np.bincount(code[c], w * have, len(wanted[c]))
            w = np.minimum(w * np.divide(wanted[c], now, out=np.ones_like(now), where=now > 0)[code[c]], cap)
        for _ in range(20):  # the source marginal comes last; what a cap cuts off goes to its other cells
            now = np.bincount(code["source"], w * have, n_src)
            w = np.minimum(w * np.divide(target, now, out=np.zeros(n_src), where=now > 0)[code["source"]], cap)
            if np.allclose(np.bincount(code["source"], w * have, n_src), target, rtol=1e-9):
                break
        if np.allclose(old, w, rtol=1e-6):
            break
    w = w.copy()
    for k in np.flatnonzero(supply > 0):  # rounds may end before a marginal is met where caps bind; the source's has to hold
        own = code["source"] == k
        w[own] = _exact(w[own], have[own], cap[own], target[k])
    # What raking leaves of a source's share is more than rounding where its caps are too low.
    reached = np.bincount(code["source"], w * have, n_src)[code["source"]]
    hoped = share * pdf["size"].to_numpy(float)
    return pdf.assign(weight=w, short=hoped - reached > 1e-9 * hoped)


def calibrate(plans: DataFrame, cells: DataFrame, marginals: DataFrame | None = None) -> DataFrame:
    """One row for each plan and cell of its sources: share, size, source_tokens, tokens, lang_share, topic_share (as
    asked for), weight and short.

    marginals: plan_id, dimension (lang or topic), value and share; dimensions that a plan lacks there keep the default.
    short: raking can't bring the source to its share of the plan's size, that is, max_repeats times its tokens is
    below it. A source without any document has one row with null language and topic.
    """
    targets = plan_targets(plans, cells)
    t = targets.withColumnRenamed("tokens", "source_tokens")
    joined = t.join(cells.where("source is not null"), "source", "left").select(
        "plan_id", "source", "lang", "topic", "share", F.col("max_repeats").cast("int").alias("max_repeats"), "size", F.col("source_tokens").cast("long").alias("source_tokens"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")
    )
    for c in ("lang", "topic"):
        if marginals is None:
            joined = joined.withColumn(f"{c}_share", F.lit(None).cast("double"))
        else:
            asked = marginals.where(F.col("dimension") == c).groupBy("plan_id", plain("value").alias(c)).agg(F.sum("share").alias(f"{c}_share"))
            joined = joined.join(fitting(asked, GROUPS), ["plan_id", c], "left")
    joined = joined.select("plan_id", "source", "lang", "topic", "share", "max_repeats", "size", "source_tokens", "tokens", "lang_share", "topic_share")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.groupBy("plan_id").applyInPandas(_rake, f"{kinds}, weight double, short boolean")


def found(calibrated: DataFrame) -> DataFrame:
    """(plan_id, source) of the sources that can't reach their share."""
    return calibrated.where("short").select("plan_id", "source").distinct()


def _systematic(d: DataFrame) -> DataFrame:
    """The rows with copies: the whole numbers that the running sum of weights passes.

    Documents come in order of size within plan and source; sums run in parts of about PART_ROWS documents, to which
    those of earlier parts are added. Of STARTS first values of the sum the one is taken whose size comes nearest to the wanted.
    """
    group = ["plan_id", "source"]
    d = d.withColumn("class", F.floor(F.log2("tokens") * 4).cast("int"))
    parts = d.groupBy(*group, "class").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    d = d.join(fitting(parts, GROUPS), [*group, "class"]).withColumn("part", F.struct("class", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("p"))).drop("class", "parts")
    before = d.groupBy(*group, "part").agg(F.sum("weight").alias("s"))
    before = before.select(*group, "part", F.coalesce(F.sum("s").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    d = d.withColumn("upto", F.sum("weight").over(Window.partitionBy(*group, "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))).join(before, [*group, "part"])
    d = checkpoint(d.withColumn("upto", F.col("before") + F.col("upto")).drop("before", "part"))
    floor = lambda v: F.floor(F.round(v, 6))  # noqa: E731  # sums of doubles may lie just below a whole number
    passed = lambda start: floor(F.col("upto") + start) - floor(F.col("upto") - F.col("weight") + start)
    tried = d.groupBy(*group).agg(*[F.sum(passed(F.lit(i / STARTS)) * F.col("tokens")).alias(f"s{i}") for i in range(STARTS)], F.sum(F.col("weight") * F.col("tokens")).alias("wanted"))
    best = tried.select(*group, F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{i}") - F.col("wanted")).alias("off"), F.lit(i / STARTS).alias("start")) for i in range(STARTS)]))["start"].alias("start"))
    d = d.join(fitting(best, GROUPS), group).withColumn("copies", passed(F.col("start")).cast("int"))
    return d.where("copies > 0").drop("weight", "upto", "start")


def draw(tokens: DataFrame, calibrated: DataFrame, large: float = LARGE) -> DataFrame:
    """(plan_id, doc_id, source, lang, topic, tokens, factor, copies) of the documents that each plan uses.

    Documents that hold more than large of their source's target are drawn first; the weights of all others are
    then scaled by one factor to what is left of the target, up to max_repeats. factor tells it (1 for the large ones),
    report() gives it for each source; with large = 1 no document but one over the whole target is drawn apart.
    """
    weights = calibrated.where("weight > 0").select("plan_id", "source", "lang", "topic", "weight", "max_repeats")
    d = tokens.where("tokens > 0 and doc_id is not null").join(fitting(weights, GROUPS), ["source", "lang", "topic"])
    group = ["plan_id", "source"]
    target = calibrated.where("weight > 0").groupBy(*group).agg(F.sum(F.col("weight") * F.col("tokens")).alias("target"))
    d = d.join(fitting(target, GROUPS), group).select("plan_id", "doc_id", "source", "lang", "topic", "tokens", "weight", "max_repeats", "target")
    columns = ["plan_id", "doc_id", "source", "lang", "topic", "tokens", "factor", "copies"]
    over = F.col("tokens") > large * F.col("target")
    first = checkpoint(_systematic(d.where(over).withColumn("factor", F.lit(1.0))).select(*columns))
    rest = d.where(~over)
    used = first.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    hoped = rest.groupBy(*group).agg(F.sum(F.col("weight") * F.col("tokens")).alias("hoped"))
    factor = target.join(used, group, "left").join(hoped, group).select(*group, (F.greatest(F.col("target") - F.coalesce("used", F.lit(0)), F.lit(0.0)) / F.col("hoped")).alias("factor"))
    rest = rest.join(fitting(factor, GROUPS), group).withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.col("max_repeats").cast("double"))).where("weight > 0")
    return first.unionByName(_systematic(rest).select(*columns))


def report(drawn: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, actual_share, target_tokens, actual_tokens, most_copies, rest_factor, short) of
    each plan's sources; rest_factor: what draw() scaled the weights of all but the largest documents by."""
    want = calibrated.groupBy("plan_id", "source").agg(F.max("share").alias("target_share"), (F.max("share") * F.max("size")).alias("target_tokens"), F.max("short").alias("short"))
    got = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("most_copies"), F.max(F.when(F.col("factor") != 1, F.col("factor"))).alias("rest_factor"))
    r = want.join(got, ["plan_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    share = F.col("actual_tokens") / F.expr("nullif(sum(actual_tokens) over (partition by plan_id), 0)")
    return r.select("plan_id", "source", "target_share", share.alias("actual_share"), "target_tokens", "actual_tokens", "most_copies", "rest_factor", "short")


def report_marginals(drawn: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(plan_id, dimension, value, asked_share, fitted_share, actual_share) of the languages and topics of each plan:
    what was asked for (null where nothing was), what raking gives, and what was drawn."""
    out = None
    for c in ("lang", "topic"):
        fitted = calibrated.where(F.col(c).isNotNull()).groupBy("plan_id", F.col(c).alias("value")).agg(F.max(f"{c}_share").alias("asked_share"), F.sum(F.col("weight") * F.col("tokens")).alias("fitted"))
        got = drawn.groupBy("plan_id", F.col(c).alias("value")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual"))
        r = fitted.join(got, ["plan_id", "value"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
        of = lambda n: (F.col(n) / F.expr(f"nullif(sum({n}) over (partition by plan_id), 0)")).alias(f"{n}_share")
        r = r.select("plan_id", F.lit(c).alias("dimension"), "value", "asked_share", of("fitted"), of("actual"))
        out = r if out is None else out.unionByName(r)
    return out
