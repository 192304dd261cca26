"""Column-level quality profile of loads.

The base of everything is one table of distinct values, (load, column, value) -> rows, which partial
aggregation shrinks before its only large shuffle. From it come null, invalid and distinct counts, the most
frequent value, the largest gap between cumulative distributions (by exact prefix sums over value ranges, so
no column is sorted in one task) and regular expressions induced by minimum description length.

Nulls and NaN are null values. An empty table gives an empty profile. Rows without a load count among the
others of every load but make no case of their own. Names of other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, clean, partitions


@dataclass(frozen=True)
class ColumnSpec:
    """value: the comparable double; invalid: a condition on the row; text: the form that expressions describe."""

    name: str
    value: Column
    invalid: Column
    text: Column


@dataclass(frozen=True)
class Limits:
    nulls: float = 0.05
    invalid: float = 0.02
    repeat: float = 0.16
    shift: float = 0.42
    pattern: float = 0.05


def value_counts(df: DataFrame, specs: list[ColumnSpec], load: str = "load_id") -> DataFrame:
    """(load_id, column_name, value, text, invalid, n), one row for each distinct value of a load and column."""
    cells = [
        F.struct(
            F.lit(s.name).alias("column_name"),
            clean(s.value).alias("value"),
            F.when(clean(s.value).isNotNull(), s.text.cast("string")).alias("text"),
            (clean(s.value).isNotNull() & F.coalesce(s.invalid, F.lit(False))).alias("invalid"),
        )
        for s in specs
    ]
    if len(cells) == 1:
        flat = df.select(F.col(load).alias("load_id"), cells[0].alias("c"))
    else:
        flat = df.select(F.col(load).alias("load_id"), F.explode(F.array(*cells)).alias("c"))
    return flat.select("load_id", "c.*").groupBy("load_id", "column_name", "value", "text", "invalid").agg(F.count(F.lit(1)).alias("n"))


def _shape(c: Column) -> Column:
    s = F.regexp_replace(c, r"\p{Lu}", "A")
    s = F.regexp_replace(s, r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]", "a")
    return F.regexp_replace(s, r"\p{N}", "9")


_PIECE = {"9": (r"\d", 10), "A": (r"\p{Lu}", 26), "a": (r"\p{L}", 26)}


def _piece(run: Column, low: Column, high: Column) -> Column:
    head = F.substring(run, 1, 1)
    name = F.when(head == "9", r"\d").when(head == "A", r"\p{Lu}").when(head == "a", r"\p{L}").otherwise(F.concat(F.lit("\\"), head))
    times = F.when(low != high, F.format_string("{%d,%d}", low, high)).when(low > 1, F.format_string("{%d}", low)).otherwise("")
    return F.concat(name, times)


def _bits(run: Column) -> Column:
    head = F.substring(run, 1, 1)
    each = F.when(head == "9", 3.322).when(head.isin("A", "a"), 4.7).otherwise(0.0)
    return each * F.length(run)


#: A number with or without sign and fraction, as its loose shape.
_NUMERIC = ("9", "-9", "9.9", "-9.9")


def _digits(low: Column, high: Column) -> Column:
    return F.concat(F.lit(r"\d"), F.when(low != high, F.format_string("{%d,%d}", low, high)).when(low > 1, F.format_string("{%d}", low)).otherwise(""))


def induce_expressions(counts: DataFrame) -> DataFrame:
    """(column_name, shape, regex): the expressions chosen for each column, one row for each shape they cover.

    All distinct values take part. A shape is a value with its letters and digits replaced by their class. Shapes are
    described by one expression each (apart), those that differ only in the length of runs by one with ranges
    (shared), and numbers with and without sign or fraction by one with optional parts (numeric). The description
    length of a set of expressions is 8 bits for each of their characters, the bits that single out each distinct
    value's letters and digits, and the bits that tell its shape, which are coded by how often shapes occur: for shared
    forms that takes 8 bits more for each shape, for forms apart the expressions themselves. The shortest form wins.
    Values that are shorter written out than described keep no expression: they are the nonconforming ones.
    """
    shapes = (
        counts.where("text is not null").select("column_name", "text").distinct()
        .groupBy("column_name", _shape(F.col("text")).alias("shape"))
        .agg(F.count(F.lit(1)).alias("d"))
        .withColumn("runs", F.regexp_extract_all("shape", F.lit(r"(9+|A+|a+|(?s:.))"), F.lit(1)))
        .withColumn("loose", F.regexp_replace("shape", r"(9|A|a)\1+", "$1"))
    )
    own = shapes.withColumn("apart", F.array_join(F.transform("runs", lambda r: _piece(r, F.length(r), F.length(r))), "")).withColumn(
        "bits", F.col("d") * F.aggregate("runs", F.lit(0.0), lambda a, r: a + _bits(r))
    )
    own = own.withColumn("family", F.when(F.col("loose").isin(*_NUMERIC), F.lit("number")).otherwise(F.col("loose")))
    own = own.withColumn("apart_cost", 8.0 * F.length("apart") + F.col("bits")).withColumn("raw", F.col("d") * 8.0 * (F.length("shape") + 1))
    own = own.select("column_name", "family", "loose", "shape", "runs", "d", "bits", "apart", "apart_cost", "raw")
    # Bits that tell which of several shapes with d values each it is: sum of d * log2(total / d).
    telling = lambda d: F.sum(d) * F.log2(F.sum(d)) - F.sum(d * F.log2(d))
    own = checkpoint(own)  # a row for each shape, read by four joins
    span = (
        own.select("column_name", "loose", F.posexplode("runs").alias("pos", "run"))
        .groupBy("column_name", "loose", "pos")
        .agg(F.min(F.length("run")).alias("low"), F.max(F.length("run")).alias("high"), F.first("run").alias("run"))
        .select("column_name", "loose", "pos", _piece(F.col("run"), F.col("low"), F.col("high")).alias("piece"))
        .groupBy("column_name", "loose")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("shared"))
    )
    by_loose = own.groupBy("column_name", "family", "loose").agg(F.sum("d").cast("double").alias("d"), F.sum("bits").alias("bits"), F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("n"), F.sum("apart_cost").alias("apart_cost"), telling(F.col("d").cast("double")).alias("telling"))
    by_loose = by_loose.join(span, ["column_name", "loose"])
    by_loose = by_loose.withColumn("shared_cost", 8.0 * F.length("shared") + F.col("bits") + F.col("telling") + 8.0 * F.col("n")).withColumn("apart_cost", F.col("apart_cost") + F.col("telling"))
    by_loose = by_loose.withColumn("loose_cost", F.least("shared_cost", "apart_cost")).drop("raw")
    number = own.where(F.col("family") == "number").withColumns({"sign": F.col("shape").startswith("-"), "whole": F.length(F.regexp_extract("shape", "^-?(9+)", 1)), "part": F.length(F.regexp_extract("shape", r"\.(9+)$", 1))})
    number = number.groupBy("column_name").agg(
        F.sum("raw").alias("raw"), F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("n"), telling(F.col("d").cast("double")).alias("telling"), F.max("sign").alias("some"), F.min("sign").alias("all"),
        F.min("whole").alias("w0"), F.max("whole").alias("w1"), F.min(F.when(F.col("part") > 0, F.col("part"))).alias("p0"), F.max("part").alias("p1"), F.min(F.col("part") > 0).alias("always"),
    )
    fraction = F.concat(F.lit(r"\."), _digits(F.col("p0"), F.col("p1")))
    regex = F.concat(F.when(F.col("all"), r"\-").when(F.col("some"), r"\-?").otherwise(""), _digits(F.col("w0"), F.col("w1")), F.when(F.col("p1") == 0, "").when(F.col("always"), fraction).otherwise(F.concat(F.lit("("), fraction, F.lit(")?"))))
    number = number.withColumn("numeric", regex).withColumn("numeric_cost", 8.0 * F.length("numeric") + F.col("bits") + F.col("telling") + 8.0 * F.col("n"))
    lower = by_loose.where(F.col("family") == "number").groupBy("column_name").agg((F.sum("loose_cost") + telling(F.col("d"))).alias("lower"))
    number = number.join(lower, "column_name").where("numeric_cost < least(lower, raw)").select("column_name", F.lit("number").alias("family"), "numeric")
    chosen = own.join(by_loose.select("column_name", "loose", "shared", "shared_cost", F.col("apart_cost").alias("apart_total")), ["column_name", "loose"]).join(number, ["column_name", "family"], "left")
    raw_total = own.groupBy("column_name", "loose").agg(F.sum("raw").alias("raw_total"))
    chosen = chosen.join(raw_total, ["column_name", "loose"])
    as_shared = F.col("shared_cost") < F.col("apart_total")
    keep = F.col("numeric").isNotNull() | F.when(as_shared, F.col("shared_cost") < F.col("raw_total")).otherwise(F.col("apart_cost") < F.col("raw"))
    return chosen.where(keep).select("column_name", "shape", F.coalesce("numeric", F.when(as_shared, F.col("shared")).otherwise(F.col("apart"))).alias("regex"))


def _distribution_gap(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(load_id, column_name, gap): the largest difference of two cumulative shares, exact over all values.

    The gap can only be largest at a value of the load or just before one, so the rows of the load suffice.
    Values are cut into ranges that hold about as many distinct values each; sums run inside a range and the
    sums of earlier ranges are added.
    """
    spark = counts.sparkSession
    parts = max(8, min(512, partitions(spark)))
    v = counts.where("value is not null").groupBy("load_id", "column_name", "value").agg(F.sum("n").alias("n"))
    bounds = v.groupBy("column_name").agg(F.percentile_approx("value", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 1000).alias("bounds"))
    v = v.join(bounds, "column_name").withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    v = v.repartition("column_name", "part")
    run = lambda *keys: Window.partitionBy(*keys).orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    v = (
        v.withColumn("ct", F.sum("n").over(run("column_name", "part")))
        .withColumn("cl", F.sum("n").over(run("column_name", "part", "load_id")))
        .withColumn("t", F.sum("n").over(Window.partitionBy("column_name", "part", "value")))
    )
    by_load = v.groupBy("column_name", "part", "load_id").agg(F.sum("n").alias("s"))
    by_part = by_load.groupBy("column_name", "part").agg(F.sum("s").alias("s"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_load = by_load.select("column_name", "part", "load_id", F.coalesce(F.sum("s").over(before("column_name", "load_id")), F.lit(0)).alias("bl"))
    by_part = by_part.select("column_name", "part", F.coalesce(F.sum("s").over(before("column_name")), F.lit(0)).alias("bt"))
    v = v.where("load_id is not null").join(by_load, ["column_name", "part", "load_id"]).join(by_part, ["column_name", "part"])
    v = v.join(totals.select("load_id", "column_name", "nonnull", "others_nonnull"), ["load_id", "column_name"])
    cl, ct = F.col("cl") + F.col("bl"), F.col("ct") + F.col("bt")
    gap = lambda a, t: F.abs(a / F.col("nonnull") - (t - a) / F.expr("nullif(others_nonnull, 0)"))
    return v.groupBy("load_id", "column_name").agg(F.max(F.greatest(gap(cl, ct), gap(cl - F.col("n"), ct - F.col("t")))).alias("gap"))


#: Share of the rows of other loads below which they hardly use a form.
RARE = 0.001
#: Values of a column that are looked at first for being the most frequent one elsewhere.
TOP = 256


def _mode_of_others(counts: DataFrame, top: int = TOP) -> DataFrame:
    """(load_id, column_name, others_mode): the most rows that one value has outside the load.

    That value is one of the load's own, which its rows tell, or the most frequent one that the load lacks. The latter is
    looked for among the top values of the column; only where a load has all of these, and they don't already beat
    what is left, more are looked at. No value meets loads that it isn't in but those top ones.
    """
    v = counts.where("value is not null").groupBy("column_name", "value", "load_id").agg(F.sum("n").alias("n"))
    totals = v.groupBy("column_name", "value").agg(F.sum("n").alias("t"))
    v = v.join(totals, ["column_name", "value"])
    v = checkpoint(v)
    loads = checkpoint(v.where("load_id is not null").groupBy("column_name", "load_id").agg(F.max(F.col("t") - F.col("n")).alias("best")))
    totals = v.select("column_name", "value", "t").distinct()
    done = None
    while True:
        w = Window.partitionBy("column_name").orderBy(F.desc("t"), "value")
        first = checkpoint(totals.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top))
        ends = first.groupBy("column_name").agg(F.min("t").alias("least"), F.count(F.lit(1)).alias("seen"))
        pairs = loads.join(first, "column_name").join(v.select("column_name", "value", "load_id", F.lit(True).alias("has")), ["column_name", "value", "load_id"], "left")
        lacking = pairs.where("has is null").groupBy("column_name", "load_id").agg(F.max("t").alias("lacked"))
        now = loads.join(lacking, ["column_name", "load_id"], "left").join(ends, "column_name", "left")
        now = now.withColumn("open", F.col("lacked").isNull() & (F.col("seen") >= top) & (F.col("least") > F.col("best")))
        now = checkpoint(now.select("column_name", "load_id", F.greatest("best", F.coalesce("lacked", F.lit(0))).alias("others_mode"), "best", "open"))
        closed = now.where("not coalesce(open, false)").select("load_id", "column_name", "others_mode")
        done = closed if done is None else done.unionByName(closed)
        loads = now.where("open").select("column_name", "load_id", "best")
        if loads.isEmpty():
            return done
        totals, top = totals.join(loads.select("column_name").distinct(), "column_name", "left_semi"), top * 16


def profile(counts: DataFrame, patterns: bool = True) -> DataFrame:
    """One row for each load and column: shares of the load beside those of all other loads together.

    counts: from value_counts, of one or several tables; it is read several times, so checkpoint it before.
    """
    per_value = counts.groupBy("load_id", "column_name", "value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("invalid"), F.col("n")).otherwise(0)).alias("bad"))
    own = per_value.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum("bad").alias("invalid"),
        F.count("value").alias("distinct_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("mode"),
    )
    sums = [F.sum(c).alias(f"all_{c}") for c in ("rows", "nulls", "invalid")]
    own = own.join(own.groupBy("column_name").agg(*sums), "column_name").where("load_id is not null")
    own = own.withColumn("nonnull", F.col("rows") - F.col("nulls"))
    for c in ("rows", "nulls", "invalid"):
        own = own.withColumn(f"others_{c}", F.col(f"all_{c}") - F.col(c)).drop(f"all_{c}")
    own = own.withColumn("others_nonnull", F.col("others_rows") - F.col("others_nulls"))
    own = checkpoint(own)
    share = lambda a, b: F.expr(f"{a} / nullif({b}, 0)")
    out = own.join(_mode_of_others(counts), ["load_id", "column_name"], "left").join(_distribution_gap(counts, own), ["load_id", "column_name"], "left")
    columns = [
        "load_id", "column_name", "rows", "distinct_values", "min_value", "max_value",
        share("nulls", "rows").alias("null_share"), share("others_nulls", "others_rows").alias("others_null_share"),
        share("invalid", "nonnull").alias("invalid_share"), share("others_invalid", "others_nonnull").alias("others_invalid_share"),
        share("mode", "nonnull").alias("mode_share"), share("others_mode", "others_nonnull").alias("others_mode_share"), "gap",
    ]
    if patterns:
        forms = counts.where("text is not null").withColumn("shape", _shape(F.col("text"))).groupBy("load_id", "column_name", "shape").agg(F.sum("n").alias("n"))
        forms = checkpoint(forms.join(induce_expressions(counts), ["column_name", "shape"], "left"))
        shaped = forms.groupBy("load_id", "column_name").agg(F.sum(F.when(F.col("regex").isNull(), F.col("n")).otherwise(0)).alias("odd"), F.count_distinct("regex").alias("expressions"))
        shaped = shaped.withColumn("all_odd", F.sum("odd").over(Window.partitionBy("column_name"))).where("load_id is not null")
        # Forms that the other loads hardly use, though an expression may cover them.
        every = forms.groupBy("column_name", "shape").agg(F.sum("n").alias("t"))
        rare = forms.where("load_id is not null").join(every, ["column_name", "shape"]).join(own.select("load_id", "column_name", "others_nonnull"), ["load_id", "column_name"])
        rare = rare.groupBy("load_id", "column_name").agg(F.sum(F.when(F.col("t") - F.col("n") < RARE * F.col("others_nonnull"), F.col("n")).otherwise(0)).alias("unusual"))
        out = out.join(shaped, ["load_id", "column_name"], "left").join(rare, ["load_id", "column_name"], "left")
        columns += ["expressions", share("odd", "nonnull").alias("nonconforming_share"), F.expr("(all_odd - odd) / nullif(others_nonnull, 0)").alias("others_nonconforming_share"), share("unusual", "nonnull").alias("unusual_form_share")]
    return out.select(*columns)


def issues(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(load_id, column_name, issue) of the columns that went wrong in a load; pattern needs expressions."""
    tests = [
        ("nulls", F.col("null_share") - F.col("others_null_share") > limits.nulls),
        ("range", F.col("invalid_share") - F.col("others_invalid_share") > limits.invalid),
        ("repeat", F.col("mode_share") - F.col("others_mode_share") > limits.repeat),
        ("shift", F.col("gap") > limits.shift),
    ]
    if "nonconforming_share" in profiled.columns:
        odd = F.col("nonconforming_share") - F.col("others_nonconforming_share") > limits.pattern
        tests.append(("pattern", odd | (F.col("unusual_form_share") > limits.pattern)))
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))
    return profiled.select("load_id", "column_name", F.explode(found).alias("issue"))


def union_counts(parts: list[DataFrame]) -> DataFrame:
    return checkpoint(reduce(DataFrame.unionByName, parts))
