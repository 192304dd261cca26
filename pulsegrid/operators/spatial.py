"""Points in polygons by three algorithms: winding number, winding number with edges, ray casting.

The polygon is a ring that closes from its last vertex to its first. Winding number and ray casting count left and
bottom edges as inside, right and top ones not; with edges, all vertices and every edge point count except the
inside of horizontal edges. NaN and null points are outside, as is everything for one or two vertices but their own
points with edges.

A batch of points is sorted by y once; each edge then meets only the points in its range of y.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDING, WINDING_EDGES, RAYCAST = 0, 1, 2
#: Pairs of edge and point that are worked on at once.
PAIRS = 1_000_000


def ring(x: Sequence[float], y: Sequence[float], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Checked vertices as arrays; single keeps 32-bit floats."""
    xs, ys = np.asarray(x), np.asarray(y)
    for a in (xs, ys):
        if a.ndim != 1 or not np.issubdtype(a.dtype, np.number) or np.issubdtype(a.dtype, np.complexfloating):
            raise ValueError("vertices must be real numbers in one dimension")
    if len(xs) != len(ys) or not len(xs):
        raise ValueError("x and y need the same number of vertices, at least one")
    kind = np.float32 if single else np.float64
    return xs.astype(kind), ys.astype(kind)


def side_of(x1, y1, x2, y2, px, py):
    """Above 0 left of the line, below 0 right of it, 0 on it."""
    return (py - y1) * (x2 - x1) - (px - x1) * (y2 - y1)


def inside(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray, algorithm: int = WINDING) -> np.ndarray:
    """Whether each point is inside; any algorithm but 1 and 2 is the winding number."""
    n = len(px)
    out = np.zeros(n, bool)
    box = (px >= xs.min()) & (px <= xs.max()) & (py >= ys.min()) & (py <= ys.max())
    chosen = np.flatnonzero(box)
    if not len(chosen):
        return out
    order = chosen[np.argsort(py[chosen], kind="stable")]
    qx, qy = px[order], py[order]
    x1, y1, x2, y2 = np.roll(xs, 1), np.roll(ys, 1), xs, ys
    first = np.searchsorted(qy, np.minimum(y1, y2), "left")
    count = np.searchsorted(qy, np.maximum(y1, y2), "left") - first
    turns = np.zeros(len(order), np.int64)
    touch = np.zeros(len(order), bool)
    total = np.cumsum(count)
    at = 0
    while at < len(xs):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:stop]
        e = np.repeat(np.arange(at, stop), c)
        at = stop
        if not len(e):
            continue
        p = np.arange(len(e)) - np.repeat(np.cumsum(c) - c, c) + first[e]
        if algorithm == RAYCAST:
            hit = qx[p] < (x1[e] - x2[e]) * (qy[p] - y2[e]) / (y1[e] - y2[e]) + x2[e]
            turns += np.bincount(p[hit], minlength=len(order))
            continue
        side = side_of(x1[e], y1[e], x2[e], y2[e], qx[p], qy[p])
        up = y1[e] <= qy[p]
        turns += np.bincount(p[up & (side > 0)], minlength=len(order)) - np.bincount(p[~up & (side < 0)], minlength=len(order))
        if algorithm == WINDING_EDGES:
            touch[p[side == 0]] = True
    found = turns % 2 == 1 if algorithm == RAYCAST else turns != 0
    if algorithm == WINDING_EDGES:
        found |= touch | np.isin(qx + 1j * qy, xs + 1j * ys)
    out[order] = found
    return out


def _numbers(a: pa.Array, kind: type) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(kind)


def is_inside(x: str | Column, y: str | Column, poly_x: Sequence[float], poly_y: Sequence[float], algorithm: int = WINDING, single: bool = False) -> Column:
    """A boolean column: whether (x, y) is inside the polygon."""
    xs, ys = ring(poly_x, poly_y, single)

    @F.arrow_udf(returnType=T.BooleanType())
    def test(px: pa.Array, py: pa.Array) -> pa.Array:
        return pa.array(inside(_numbers(px, xs.dtype.type), _numbers(py, xs.dtype.type), xs, ys, algorithm))

    return test(x, y)


def select_inside(points: DataFrame, poly_x: Sequence[float], poly_y: Sequence[float], x: str = "x", y: str = "y", algorithm: int = WINDING) -> DataFrame:
    """The rows inside. The polygon's box is a plain filter before, which scans can use."""
    xs, ys = ring(poly_x, poly_y)
    box = F.col(x).between(float(xs.min()), float(xs.max())) & F.col(y).between(float(ys.min()), float(ys.max()))
    return points.where(box).where(is_inside(x, y, xs, ys, algorithm))


def select_outside(points: DataFrame, poly_x: Sequence[float], poly_y: Sequence[float], x: str = "x", y: str = "y", algorithm: int = WINDING) -> DataFrame:
    return points.where(~is_inside(x, y, poly_x, poly_y, algorithm))


def containing(x: str | Column, y: str | Column, polygons: Mapping[int, tuple[Sequence[float], Sequence[float]]], algorithm: int = WINDING) -> Column:
    """The sorted ids of those given polygons that (x, y) is inside of; for tables of polygons see proximity."""
    rings = {int(k): ring(*v) for k, v in sorted(polygons.items())}

    @F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
    def test(px: pa.Array, py: pa.Array) -> pa.Array:
        qx, qy = _numbers(px, np.float64), _numbers(py, np.float64)
        hits = np.stack([inside(qx, qy, *r, algorithm) for r in rings.values()], axis=1) if rings else np.zeros((len(qx), 0), bool)
        ids = np.array(list(rings), np.int32)
        row, col = np.nonzero(hits)
        offsets = np.r_[0, np.cumsum(hits.sum(axis=1))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[col]))

    return test(x, y)


def winding_by_edges(points: DataFrame, ident: str, poly_x: Sequence[float], poly_y: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """(ident, winding) of the points about which the ring winds, by a join with its edges and a sum, without Python."""
    xs, ys = ring(poly_x, poly_y)
    spark = points.sparkSession
    rows = list(zip(np.roll(xs, 1).tolist(), np.roll(ys, 1).tolist(), xs.tolist(), ys.tolist()))
    edges = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    p = points.where(F.col(x).between(float(xs.min()), float(xs.max())) & F.col(y).between(float(ys.min()), float(ys.max())))
    px, py = F.col(x), F.col(y)
    side = (py - F.col("y1")) * (F.col("x2") - F.col("x1")) - (px - F.col("x1")) * (F.col("y2") - F.col("y1"))
    # The ring is in the driver's memory already, so it is small enough to be sent to all tasks.
    met = p.join(F.broadcast(edges), (py >= F.least("y1", "y2")) & (py < F.greatest("y1", "y2")))
    turn = F.when((F.col("y1") <= py) & (side > 0), 1).when((F.col("y1") > py) & (side < 0), -1).otherwise(0)
    return met.groupBy(ident).agg(F.sum(turn).alias("winding")).where("winding <> 0")


def circle(x: float, y: float, radius: float, vertices: int) -> tuple[np.ndarray, np.ndarray]:
    """A ring of vertices, clockwise, the last one at the top."""
    turn = 2.0 * np.pi * np.arange(1, vertices + 1) / vertices
    return x + radius * np.sin(turn), y + radius * np.cos(turn)
