"""Points near other points, and points inside regions.

Near pairs: every point is hashed to a square cell a few radii wide and copied into those neighbouring cells of
lower order that lie within the radius; one shuffle by cell serves both sides of a join, which meets each pair once,
and the exact distance decides. Cells that hold very many points are split into a square of salted parts, each joined
with each.

Regions: polygons are hashed to cells of a size that fits them (one grid for every second power of two in use), points
to the cell of each grid in use; candidates are joined with the polygon's edges by (polygon, band of y), bands
being as many as the polygon has pairs of edges, and what the edges say is summed. No polygon is gathered in one row and no edge list is
looped over. Where cells or edges are too many to be sent to all tasks both joins shuffle, crowded cells and polygons
in salted parts.

Coordinates count in whole millimetres, so the distance test is exact. Points with a null, NaN or infinite
coordinate and rows with a null id are left out; repeated rows of one id count once. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, clean, fitting, millimetres, small
from .spatial import RAYCAST, WINDING, WINDING_EDGES

#: Points of one cell that one task may meet with as many others.
HOT_CELL = 20_000
#: The mean radius of the earth in metres.
EARTH_M = 6_371_008.8
#: Rows up to which a side is broadcast. A row has at most eight numbers, about 100 bytes as a hash table holds it, so
#: one side takes at most 20 MB and the three of a plan at most 60 MB.
BROADCAST_ROWS = 200_000
#: Candidates of one polygon that go to one part, where edges are not broadcast.
HOT_POLYGON = 1_000_000
#: Most bands of a polygon.
BANDS = 1024


def located(points: DataFrame, ident: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, x, y) in whole millimetres; repeated rows are still there."""
    return points.select(F.col(ident).alias("id"), millimetres(x).alias("x"), millimetres(y).alias("y")).where("id is not null and x is not null and y is not null")


def _cell(c: Column, size: int) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def _hot_cells(p: DataFrame, size: int, limit: int) -> DataFrame | None:
    """(cx, cy, parts) of the cells with over limit rows, None if there are none.

    First whole tiles of 64 x 64 cells are counted, which are few, then the cells of the heavy tiles only.
    """
    tiles = checkpoint(p.groupBy(_cell(F.col("x"), size * 64).alias("tx"), _cell(F.col("y"), size * 64).alias("ty")).count().where(F.col("count") > limit))
    if tiles.isEmpty():
        return None
    cells = (
        p.withColumns({"tx": _cell(F.col("x"), size * 64), "ty": _cell(F.col("y"), size * 64)})
        .join(fitting(tiles.select("tx", "ty"), BROADCAST_ROWS), ["tx", "ty"], "left_semi")
        .groupBy(_cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
        .count()
        .where(F.col("count") > limit)
        .select("cx", "cy", F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    )
    return None if cells.isEmpty() else cells


def _in_parts(home: DataFrame, other: DataFrame, crowded: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the parts of crowded cells in their keys: each part of one side meets each of the other."""
    crowded = fitting(crowded, BROADCAST_ROWS)
    part = lambda seed: F.coalesce(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int"), F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    home = home.join(crowded, keys, "left").withColumn("pa", part(1)).withColumn("pb", F.explode(every)).drop("parts")
    other = other.join(crowded, keys, "left").withColumn("pb", part(2)).withColumn("pa", F.explode(every)).drop("parts")
    return home, other, [*keys, "pa", "pb"]


def _shared_cells(points: DataFrame, radius_mm: float, ident: str, x: str, y: str, hot: int) -> tuple[DataFrame, list[str]]:
    """The rows of every cell (own points and those of the halo), partitioned by cell, and the keys that make a cell.

    role: 0 either side of the join, 1 first side, 2 second side only. Readers filter through _after(), so that all of
    them read one and the same shuffle.
    """
    size, reach = math.ceil(radius_mm) * 4, math.ceil(radius_mm)
    p = located(points, ident, x, y)
    cx, cy = _cell(F.col("x"), size), _cell(F.col("y"), size)
    fx, fy = F.col("x") - cx * size, F.col("y") - cy * size
    at = lambda ok, dx, dy: F.when(ok, F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy"), F.lit(False).alias("own")))
    left, low, high = fx <= reach, fy <= reach, fy >= size - reach
    halo = F.array_compact(F.array(F.struct(cx.alias("cx"), cy.alias("cy"), F.lit(True).alias("own")), at(left, -1, 0), at(left & low, -1, -1), at(left & high, -1, 1), at(low, 0, -1)))
    rows = p.select("id", "x", "y", F.explode(halo).alias("h")).select("id", "x", "y", "h.*")
    crowded = _hot_cells(p, size, hot)
    keys = ["cx", "cy"]
    if crowded is None:
        rows = rows.withColumn("role", F.when(F.col("own"), 0).otherwise(2))
    else:
        keys += ["pa", "pb"]
        part = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        as_home = F.transform(every, lambda k: F.struct(part(1).alias("pa"), k.alias("pb"), F.lit(1).alias("role")))
        as_other = F.transform(every, lambda k: F.struct(k.alias("pa"), part(2).alias("pb"), F.lit(2).alias("role")))
        one = F.array(F.struct(F.lit(0).alias("pa"), F.lit(0).alias("pb"), F.when(F.col("own"), 0).otherwise(2).alias("role")))
        copies = F.when(F.col("parts").isNull(), one).when(F.col("own"), F.concat(as_home, as_other)).otherwise(as_other)
        rows = rows.join(fitting(crowded, BROADCAST_ROWS), ["cx", "cy"], "left").withColumn("k", F.explode(copies)).select("id", "x", "y", "own", "cx", "cy", "k.*")
    return rows.repartition(*keys), keys


def _after(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows with the condition, tested behind the shuffle: a filter that asks for the task isn't moved before it."""
    return rows.where(F.when(F.spark_partition_id() >= 0, condition))


def _pairs(rows: DataFrame, keys: list[str], radius_mm: float) -> DataFrame:
    reach, limit = math.ceil(radius_mm), math.floor(radius_mm * radius_mm)
    # Repeated rows lie in one cell, so the partitioning of the join also serves to drop them.
    a = _after(rows, F.col("own") & F.col("role").isin(0, 1)).dropDuplicates([*keys, "id"]).alias("a")
    b = _after(rows, F.col("role").isin(0, 2)).dropDuplicates([*keys, "id"]).alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    once = F.when(F.col("b.own"), F.col("a.id") < F.col("b.id")).otherwise(F.col("a.id") != F.col("b.id"))
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.abs(dx) <= reach, F.abs(dy) <= reach, dx * dx + dy * dy <= limit, once])
    return met.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def near_pairs(points: DataFrame, radius_mm: float, ident: str = "point_id", x: str = "x", y: str = "y", hot: int = HOT_CELL) -> DataFrame:
    """(id_a, id_b), smaller first, of all points at most radius_mm millimetres apart.

    Copies at one place are near each other (distance 0). The result holds every pair, so its size is that of
    the question; no cell, however full, is met in one task.
    """
    return _pairs(*_shared_cells(points, radius_mm, ident, x, y, hot), radius_mm)


def near_on_earth(points: DataFrame, radius_m: float, ident: str = "id", lon: str = "lon", lat: str = "lat", hot: int = HOT_CELL) -> DataFrame:
    """(id_a, id_b), smaller first, of all places (in degrees) at most radius_m apart along a great circle.

    Places are hashed to cells of space, so that poles and the date line need no care; the exact distance on a
    sphere of EARTH_M decides. Null, NaN and impossible places and null ids are left out, repeated rows count once.
    """
    p = points.select(F.col(ident).alias("id"), clean(lon).alias("lon"), clean(lat).alias("lat")).where("id is not null and lon is not null and lat between -90 and 90")
    a, b = F.radians("lon"), F.radians("lat")
    p = p.withColumns({"x": F.cos(a) * F.cos(b) * EARTH_M, "y": F.sin(a) * F.cos(b) * EARTH_M, "z": F.sin(b) * EARTH_M})
    reach = 2 * EARTH_M * math.sin(min(radius_m / (2 * EARTH_M), math.pi / 2)) * (1 + 1e-9) + 1e-3
    size = 4 * reach
    axes = ("x", "y", "z")
    keys = [f"c{c}" for c in axes]
    home = p.withColumns({f"c{c}": F.floor(F.col(c) / size).cast("long") for c in axes})
    other = home
    for c in axes:
        within = F.col(c) - F.col(f"c{c}") * size
        other = other.withColumn(f"d{c}", F.explode(F.array_compact(F.array(F.lit(0), F.when(within <= reach, -1), F.when(within >= size - reach, 1)))))
    order = F.col("dx") * 9 + F.col("dy") * 3 + F.col("dz")
    other = other.where(order <= 0).withColumn("own", order == 0).select("id", "lon", "lat", "own", *[(F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in axes])
    home = home.select("id", "lon", "lat", *keys)
    crowded = checkpoint(home.groupBy(*keys).count().where(F.col("count") > hot).select(*keys, F.ceil(F.col("count") / hot).cast("int").alias("parts")))
    if not crowded.isEmpty():
        home, other, keys = _in_parts(home, other, crowded, keys)
    home = home.repartition(*keys).dropDuplicates([*keys, "id"]).alias("a")
    other = other.repartition(*keys).dropDuplicates([*keys, "id"]).alias("b")
    half = lambda n: F.sin((F.radians(f"a.{n}") - F.radians(f"b.{n}")) / 2)
    h = half("lat") * half("lat") + F.cos(F.radians("a.lat")) * F.cos(F.radians("b.lat")) * half("lon") * half("lon")
    far = 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    once = F.when(F.col("b.own"), F.col("a.id") < F.col("b.id")).otherwise(F.col("a.id") != F.col("b.id"))
    met = home.join(other, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [once, far <= radius_m])
    return met.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def polygon_edges(polygons: DataFrame, poly: str = "poly_id", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(poly_id, seq, x1, y1, x2, y2) in millimetres; the ring closes from its last vertex to its first.

    Repeated vertices count once. Polygons with a null or NaN vertex or with fewer than three are left out.
    """
    v = polygons.select(F.col(poly).alias("poly_id"), F.col(seq).alias("seq"), millimetres(x).alias("x"), millimetres(y).alias("y")).where("poly_id is not null and seq is not null").dropDuplicates(["poly_id", "seq"])
    w = Window.partitionBy("poly_id").orderBy("seq")
    ends = F.struct("x", "y")
    v = v.withColumns({"next": F.coalesce(F.lead(ends).over(w), F.first(ends).over(w)), "good": F.min((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).over(Window.partitionBy("poly_id")), "n": F.count(F.lit(1)).over(Window.partitionBy("poly_id"))})
    return v.where("good = 1 and n >= 3").select("poly_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("next.x").alias("x2"), F.col("next.y").alias("y2"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, ident: str = "point_id", x: str = "x", y: str = "y", algorithm: int = WINDING) -> DataFrame:
    """(poly_id, id): the points inside each polygon.

    algorithm: as in spatial, the winding number with half-open edges, the same with edges and vertices (all but the
    inside of horizontal edges), or ray casting; any other number is the winding number.
    """
    return _inside(located(points, ident, x, y), polygons, algorithm)


def _inside(located_points: DataFrame, polygons: DataFrame, algorithm: int = WINDING) -> DataFrame:
    edges = checkpoint(polygon_edges(polygons))  # read by four jobs
    boxes = edges.groupBy("poly_id").agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"), F.count(F.lit(1)).alias("n"))
    # Level k has cells of 2**k mm; a box meets at most two cells in either direction. Every second level is in use.
    level = F.greatest(F.lit(10), F.ceil(F.log2(F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(1)))).cast("int"))
    # About two edges of a band cross it and two more begin or end in it, whatever the polygon's size and detail.
    bands = F.least(F.greatest(F.ceil(F.col("n") / 2), F.lit(4)), F.lit(BANDS))
    boxes = boxes.withColumn("level", level + level % 2).withColumn("height", (F.col("y9") - F.col("y0") + 1) / bands).drop("n")
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # at most 32 numbers
    if not levels:
        return located_points.select(F.lit(None).cast("long").alias("poly_id"), "id").where("false")
    at = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    cover = (
        boxes.withColumn("cx", F.explode(F.sequence(at("x0", F.col("level")), at("x9", F.col("level")))))
        .withColumn("cy", F.explode(F.sequence(at("y0", F.col("level")), at("y9", F.col("level")))))
    )
    band = lambda y: F.floor((y - F.col("y0")) / F.col("height")).cast("int")
    banded = edges.join(boxes.select("poly_id", "y0", "height"), "poly_id")
    top = F.greatest("y1", "y2")
    if algorithm != WINDING_EDGES:  # without edges a horizontal edge and the upper end of an edge say nothing
        banded, top = banded.where("y1 <> y2"), top - 1
    banded = banded.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(top)))).drop("y0", "height")

    p = located_points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    p = p.withColumns({"cx": at("x", F.col("level")), "cy": at("y", F.col("level"))})
    in_box = "x between x0 and x9 and y between y0 and y9"
    few_cells, few_edges = small(cover, BROADCAST_ROWS), small(banded, BROADCAST_ROWS)
    parts = None
    if few_cells and few_edges:
        near = p.join(F.broadcast(cover), ["level", "cx", "cy"]).where(in_box)
    else:
        # Points of each cell are counted once: crowded cells are met in parts, and so are polygons with crowded cells.
        counts = checkpoint(p.join(cover.select("level", "cx", "cy").distinct(), ["level", "cx", "cy"], "left_semi").groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n")))
        near = _met(p, cover, ["level", "cx", "cy"], counts.select("level", "cx", "cy", F.ceil(F.col("n") / HOT_POLYGON).cast("int").alias("parts")).where("parts > 1")).where(in_box)
        parts = cover.join(counts, ["level", "cx", "cy"]).groupBy("poly_id").agg(F.ceil(F.sum("n") / HOT_POLYGON).cast("int").alias("parts")).where("parts > 1")
    near = near.select("poly_id", "id", "x", "y", band(F.col("y")).alias("band"))
    met = near.join(F.broadcast(banded), ["poly_id", "band"]) if parts is None else _met(near, banded, ["poly_id", "band"], parts)

    px, py = F.col("x"), F.col("y")
    side = (F.col("x2") - F.col("x1")).cast("double") * (py - F.col("y1")) - (px - F.col("x1")).cast("double") * (F.col("y2") - F.col("y1"))
    across = (F.col("y1") > py) != (F.col("y2") > py)
    if algorithm == RAYCAST:
        hit = across & (px < (F.col("x1") - F.col("x2")).cast("double") * (py - F.col("y2")) / (F.col("y1") - F.col("y2")) + F.col("x2"))
        # Edges are counted once for a point, however often its row is repeated.
        return met.where(hit).groupBy("poly_id", "id").agg(F.count_distinct("seq").alias("crossings")).where("crossings % 2 = 1").select("poly_id", "id")
    turn = F.when((F.col("y1") <= py) & (F.col("y2") > py) & (side > 0), 1).when((F.col("y1") > py) & (F.col("y2") <= py) & (side < 0), -1)
    touch = ((px == F.col("x2")) & (py == F.col("y2"))) | (across & (side == 0)) if algorithm == WINDING_EDGES else F.lit(False)
    said = met.select("poly_id", "id", turn.alias("turn"), touch.alias("touch")).where("turn is not null or touch")
    # Repeated rows of a point multiply its sum, which keeps it from or at 0.
    return said.groupBy("poly_id", "id").agg(F.sum("turn").alias("winding"), F.max("touch").alias("touched")).where("winding <> 0 or touched").select("poly_id", "id")


def _met(points: DataFrame, other: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """A shuffled join in which points of keys that have parts are spread over them and the other side is copied."""
    parts = fitting(parts.select(*[k for k in keys if k in parts.columns], "parts"), BROADCAST_ROWS)
    on = [k for k in keys if k in parts.columns]
    points = points.join(parts, on, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    other = other.join(parts, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return points.join(other, [*keys, "part"])


def found(points: DataFrame, polygons: DataFrame, radius_mm: float = 300.5) -> DataFrame:
    """(kind, id_a, id_b): near pairs of points, and polygons with the points inside; points are read twice, once to
    find crowded cells and once for everything else."""
    rows, keys = _shared_cells(points, radius_mm, "point_id", "x", "y", HOT_CELL)
    pairs = _pairs(rows, keys, radius_mm).select(F.lit("near").alias("kind"), "id_a", "id_b")
    once = F.col("own") & ((F.col("role") == 0) | (F.col("role") == 1) & (F.col("pb") == 0) if "pb" in keys else F.col("role") == 0)
    own = _after(rows, once).select("id", "x", "y")
    inside = _inside(own, polygons).select(F.lit("region").alias("kind"), F.col("poly_id").alias("id_a"), F.col("id").alias("id_b"))
    return pairs.unionByName(inside)
