"""Statistics that headers carry, each one partial aggregation and a shuffle of a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def bounds(points: DataFrame) -> DataFrame:
    """One row: min and max of x, y and z, and the number of points; null bounds if there are none."""
    return points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("number_of_point_records"))


def midpoints(points: DataFrame) -> DataFrame:
    return points.agg(*[(0.5 * (F.max(a) + F.min(a))).alias(f"mid_{a}") for a in AXES])


def returns(points: DataFrame, number: str | Column = "return_number", bins: int = 5) -> DataFrame:
    """(return_number, points): all returns from 1 to bins, those that no point has with 0."""
    n = F.col(number) if isinstance(number, str) else number
    seen = points.groupBy(n.alias("return_number")).agg(F.count(F.lit(1)).alias("points"))
    every = points.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("return_number"))
    return every.join(seen, "return_number", "left").select("return_number", F.coalesce("points", F.lit(0)).alias("points"))


def exact_mean(raw: str, scale: float, offset: float) -> Column:
    """The mean of coordinates through the exact sum of their integers, independent of row order."""
    return F.sum(F.col(raw).cast("long")) / F.count(raw) * F.lit(scale) + F.lit(offset)


def centred(points: DataFrame, columns: list[str]) -> DataFrame:
    """Adds d_<column>, the difference from the column's mean; the means are one row."""
    means = points.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = points.crossJoin(F.broadcast(means))
    return joined.select(*points.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(f"d_{c}") for c in columns])


def max_deviation(pairs: list[tuple[str, str]]) -> Column:
    return F.max(F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in pairs])) if len(pairs) > 1 else F.max(F.abs(F.col(pairs[0][0]) - F.col(pairs[0][1])))


def farthest(points_bounds: DataFrame, offsets: dict[str, float]) -> DataFrame:
    """The largest distance of the bounds from the offset, by axis."""
    return points_bounds.select(*[F.greatest(F.abs(F.col(f"min_{a}") - offsets[a]), F.abs(F.col(f"max_{a}") - offsets[a])).alias(f"far_{a}") for a in AXES])
