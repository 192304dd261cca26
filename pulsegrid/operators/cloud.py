"""A point cloud: its points, header and records, all of them immutable; every operation gives a new one."""

from __future__ import annotations

import base64
import json
import warnings
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import formats, las, vlr
from ..sources import header as headers
from . import extrabytes, records
from .stats import bounds


@dataclass(frozen=True)
class PointCloud:
    points: DataFrame
    header: dict
    records: DataFrame

    def with_points(self, points: DataFrame) -> PointCloud:
        return replace(self, points=points)

    def with_header(self, **fields) -> PointCloud:
        return replace(self, header=self.header | fields)


def no_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType(vlr.SCHEMA.fields[1:]))


def read_cloud(spark: SparkSession, path: str, part: str = "all") -> PointCloud:
    """part: all, xyzi (coordinates and intensity only) or vlr (no points)."""
    las.register(spark)
    h, _ = las.checked(path)
    reader = lambda **o: spark.read.format("las").options(**o).load(path)
    if part == "vlr":
        points = spark.createDataFrame([], formats.point_schema(h["point_data_format"], h["point_data_record_length"]))
    else:
        points = reader(columns="x,y,z,intensity") if part == "xyzi" else reader()
    return PointCloud(points, h, reader(part="vlr").drop("file_name"))


def new_point_cloud(spark: SparkSession, minor: int = 4) -> PointCloud:
    pdrf = 0 if minor < 4 else 6
    return PointCloud(spark.createDataFrame([], formats.point_schema(pdrf, formats.base_length(pdrf))), headers.default(pdrf, minor), no_records(spark))


def _zero(f: T.StructField):
    return F.lit(bytearray() if isinstance(f.dataType, T.BinaryType) else 0).cast(f.dataType)


def allocate(spark: SparkSession, n: int, minor: int, pdrf: int) -> PointCloud:
    """A cloud of n points with zeros in every field of the format."""
    schema = formats.point_schema(pdrf, formats.base_length(pdrf))
    points = spark.range(n).select(F.col("id").alias("point_index"), *[_zero(f).alias(f.name) for f in schema.fields[1:]])
    return PointCloud(points, headers.default(pdrf, minor), no_records(spark))


def random_cloud(spark: SparkSession, n: int, pdrf: int, seed: int = 1) -> PointCloud:
    """A cloud of random readings over the whole range of each field; the same for the same seed and partitions."""
    h = headers.default(pdrf)
    columns = []
    for i, (name, code, kind) in enumerate(formats.layout(pdrf)):
        r = F.rand(seed * 1000 + i)
        if name in ("x", "y", "z"):
            s = F.lit(h[f"scale_factor_{name}"])
            v = F.round(r / s) * s
        elif code[0] == "f":
            v = F.col("id") + r  # reals grow with the point, as times do
        else:
            limits = np.iinfo(code)
            span = min(float(limits.max) - float(limits.min) + 1.0, 2.0**53)  # doubles are whole up to there
            v = F.floor(r * span) + F.lit(int(limits.min))
        columns.append(v.cast(kind).alias(name))
    return PointCloud(spark.range(0, n, 1, 4).select(F.col("id").alias("point_index"), *columns), h, no_records(spark))


def convert_format(points: DataFrame, pdrf: int, keep_extra: bool = True, fill: float | None = None) -> DataFrame:
    """The columns of another format: zeros for those the points lack (with a warning), surplus ones dropped.

    Nulls in columns that the points have stay null, which a file can't hold, so writing them raises; fill is put in
    their place where it is given (never for coordinates).
    """
    wanted = formats.point_schema(pdrf, formats.base_length(pdrf)).fields
    missing = [f.name for f in wanted if f.name not in points.columns]
    if missing:
        warnings.warn(f"format {pdrf} gets zeros in {', '.join(missing)}", stacklevel=2)
    filled = lambda f: F.col(f.name) if fill is None or f.name in ("x", "y", "z") else F.coalesce(F.col(f.name), F.lit(fill).cast(f.dataType))
    columns = [filled(f).cast(f.dataType).alias(f.name) if f.name in points.columns else _zero(f).alias(f.name) for f in wanted]
    extra = ["extradata"] if keep_extra and "extradata" in points.columns else []
    return points.select(*columns, *extra)


def write_cloud(
    cloud: PointCloud, path: str, pdrf: int | None = None, minor: int | None = None, layout: str | None = None, partitions: int | None = None, ordered: bool = False, fill: float | None = None
) -> PointCloud:
    """Writes the points in order of point_index and gives the cloud as written (read back lazily).

    Without pdrf that of the header is used. Count, bounds, returns and the places of records are computed anew;
    the records' data go through the driver, as the header's do. layout: file for paths in .las, else folder, unless
    named. ordered: the points are in order of point_index already, so they are not sorted by range. fill: as in
    convert_format.
    """
    las.register(cloud.points.sparkSession)
    pdrf = cloud.header["point_data_format"] if pdrf is None else pdrf
    points = convert_format(cloud.points, pdrf, fill=fill)
    layout = layout or ("file" if path.lower().endswith(".las") else "folder")
    extra = 0
    if "extradata" in points.columns:
        widest = points.agg(F.max(F.length("extradata")).alias("w")).first()["w"]
        extra = int(widest or 0)
    rows = cloud.records.orderBy("is_extended", "idx").collect()
    given = [{"is_extended": r["is_extended"], "reserved": r["reserved"], "user_id": r["user_id"], "record_id": r["record_id"], "description": r["description"], "data": base64.b64encode(bytes(r["data"] or b"")).decode()} for r in rows]
    options = {"pdrf": str(pdrf), "extra_bytes": str(extra), "layout": layout, "vlrs": json.dumps(given), "header": json.dumps({k: v for k, v in cloud.header.items() if k != "number_of_point_records" and not isinstance(v, list) or k == "project_id_guid4"}, default=int)}
    if minor is not None:
        options["minor"] = str(minor)
    if not ordered:
        points = points.repartitionByRange(partitions, "point_index") if partitions else points.repartitionByRange("point_index")
        points = points.sortWithinPartitions("point_index")
    points.drop("point_index").write.format("las").options(**options).mode("overwrite").save(path)
    return read_cloud(cloud.points.sparkSession, path) if layout == "file" else cloud


def same(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> bool:
    """Whether two tables hold the same rows, as often, in the columns not ignored; columns may differ in order."""
    columns = sorted(c for c in a.columns if c not in ignore)
    if columns != sorted(c for c in b.columns if c not in ignore):
        return False
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def update_offsets(cloud: PointCloud, rounding: float = 1.0, leftside: bool = False) -> PointCloud:
    """Offsets near the middle (or the low end) of the bounds, rounded to a multiple."""
    from ..functions.codecs import updated_offset

    b = bounds(cloud.points)
    r = b.select(*[updated_offset(f"min_{a}", f"max_{a}", rounding, leftside).alias(a) for a in "xyz"]).first()
    return cloud.with_header(**{f"{a}_offset": r[a] for a in "xyz" if r[a] is not None})


def optimise_scale(cloud: PointCloud) -> PointCloud:
    """The smallest scales that hold the bounds; an axis without extent keeps its scale."""
    b = bounds(cloud.points).first()
    out = {}
    for a in "xyz":
        if b[f"min_{a}"] is not None:
            far = max(abs(b[f"min_{a}"] - cloud.header[f"{a}_offset"]), abs(b[f"max_{a}"] - cloud.header[f"{a}_offset"]))
            if far > 0:
                out[f"scale_factor_{a}"] = far / (2**31 - 1)
    return cloud.with_header(**out)


def add_wkt(cloud: PointCloud, wkt: str) -> PointCloud:
    """Puts in the coordinate system and sets its flag in the header."""
    return replace(cloud, records=records.upsert_text(cloud.records, wkt, records.WKT)).with_header(global_encoding=int(cloud.header["global_encoding"]) | 16)


def add_text_area(cloud: PointCloud, text: str) -> PointCloud:
    return replace(cloud, records=records.upsert_text(cloud.records, text, records.TEXT_AREA))


def encode_extrabytes(cloud: PointCloud, extra: extrabytes.ExtraBytes, description: str = records.EXTRA_BYTES[2]) -> PointCloud:
    """Packs the named columns behind those already packed and puts in their descriptors."""
    spark = cloud.points.sparkSession
    old = cloud.records.where("user_id = 'LASF_Spec' and record_id = 4").select("data").head()
    packed = (bytes(old["data"]) if old else b"") + extra.pack()
    new = spark.createDataFrame([("LASF_Spec", 4, description, bytearray(packed))], "user_id string, record_id int, description string, data binary")
    return replace(cloud, points=extrabytes.encode(cloud.points, extra), records=records.upsert(cloud.records, new))


def extra_fields(cloud: PointCloud) -> extrabytes.ExtraBytes:
    """The declared fields; raises if there are none."""
    got = cloud.records.where("user_id = 'LASF_Spec' and record_id = 4").select("data").head()
    if got is None:
        raise ValueError("the cloud has no extra bytes")
    return extrabytes.ExtraBytes.unpack(bytes(got["data"]))


def decode_extrabytes(cloud: PointCloud) -> DataFrame:
    return extrabytes.decode(cloud.points, extra_fields(cloud))
