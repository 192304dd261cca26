"""Queries of the file, codec, record and polygon operators, with the SQL they are checked against.

The points are derived from lineitem; everything is made of whole numbers, so both engines agree to the last bit.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as K
from ..operators import cloud, extrabytes, proximity, records, spatial, stats
from ..session import checkpoint, read, shared_folder
from ..sources import formats, las
from ..sources import header as headers

c, lit = F.col, F.lit
PDRFS = formats.SUPPORTED

POINTS_SQL = """p0 as (select cast(round(l_extendedprice*100) as bigint) as xi, cast(round(l_quantity*100) as bigint) as yi, cast(round(l_discount*100) as bigint) as zi,
  cast(l_suppkey % 65536 as integer) as intensity, l_linenumber as return_number, cast(l_partkey % 32 as integer) as classification, cast(l_orderkey % 65536 as integer) as point_source_id,
  cast(round(l_tax*100) as integer) as user_data, cast(epoch(l_shipdate) as double) as gps_time,
  case when l_linestatus = 'O' then 1 else 0 end as scan_dir, case when l_returnflag = 'R' then 1 else 0 end as edge,
  cast(l_partkey % 181 - 90 as smallint) as scan_angle, cast(l_suppkey % 251 as smallint) as bits2, cast(l_orderkey * 7 % 65536 as integer) as red, cast(l_orderkey * 11 % 65521 as integer) as green,
  cast(l_partkey * 13 % 65519 as integer) as blue, cast(l_suppkey * 17 % 65497 as integer) as nir, cast(l_linenumber as smallint) as wave_packet_descriptor,
  cast(l_orderkey * 4294967311 + l_linenumber as decimal(20,0)) as wave_byte_offset, cast(l_partkey * 20011 % 4294967296 as bigint) as wave_packet_size, cast(l_linenumber / 4e0 as float) as wave_return_point,
  cast((l_orderkey % 1000) / 8e0 as float) as xt, cast(-(l_partkey % 1000) / 8e0 as float) as yt, cast((l_suppkey % 1000) / 16e0 as float) as zt from lineitem),
points as (select *, xi*1e-2 as x, yi*1e-2 as y, zi*1e-2 as z, return_number | (7 << 3) | (scan_dir << 6) | (edge << 7) as bits from p0)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda e: F.round(e * 100).cast("long")
    p = read(spark, sf_dir, "lineitem").select(
        whole(c("l_extendedprice")).alias("xi"), whole(c("l_quantity")).alias("yi"), whole(c("l_discount")).alias("zi"),
        (c("l_suppkey") % 65536).cast("int").alias("intensity"), c("l_linenumber").cast("int").alias("return_number"), (c("l_partkey") % 32).cast("int").alias("classification"),
        (c("l_orderkey") % 65536).cast("int").alias("point_source_id"), whole(c("l_tax")).cast("int").alias("user_data"),
        F.unix_timestamp(c("l_shipdate").cast("timestamp")).cast("double").alias("gps_time"), F.when(c("l_linestatus") == "O", 1).otherwise(0).alias("scan_dir"), F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("edge"),
        (c("l_partkey") % 181 - 90).cast("smallint").alias("scan_angle"), (c("l_suppkey") % 251).cast("smallint").alias("bits2"), (c("l_orderkey") * 7 % 65536).cast("int").alias("red"), (c("l_orderkey") * 11 % 65521).cast("int").alias("green"),
        (c("l_partkey") * 13 % 65519).cast("int").alias("blue"), (c("l_suppkey") * 17 % 65497).cast("int").alias("nir"), c("l_linenumber").cast("smallint").alias("wave_packet_descriptor"),
        (c("l_orderkey").cast("long") * lit(4294967311) + c("l_linenumber")).cast("decimal(20,0)").alias("wave_byte_offset"), (c("l_partkey").cast("long") * 20011 % lit(4294967296)).cast("long").alias("wave_packet_size"), (c("l_linenumber") / 4.0).cast("float").alias("wave_return_point"),
        ((c("l_orderkey") % 1000) / 8.0).cast("float").alias("xt"), (-(c("l_partkey") % 1000) / 8.0).cast("float").alias("yt"), ((c("l_suppkey") % 1000) / 16.0).cast("float").alias("zt"),
    )
    bits = K.encode_fields({"return_number": "return_number", "number_of_returns": lit(7), "scan_direction": "scan_dir", "edge_of_flight_line": "edge"}, K.LEGACY_BITS)
    return p.select("*", *[K.decode_coordinate(f"{a}i", 0.01, 0.0).alias(a) for a in "xyz"], bits.alias("bits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def on_points(sql: str) -> str:
    return f"with {POINTS_SQL} {sql}"


# Coordinates ------------------------------------------------------------------------------------------------------


@query("coord_decode", on_points("select xi, yi, zi, x, y, z from points"))
def _(spark, d):
    return points(spark, d).select("xi", "yi", "zi", "x", "y", "z")


@query("coord_encode", on_points("select x, cast(round((x - 5e1) / 25e-2) as integer) as raw_x, y, cast(round((y - 5e1) / 25e-2) as integer) as raw_y from points"))
def _(spark, d):
    return points(spark, d).select("x", K.encode_coordinate("x", 0.25, 50.0).alias("raw_x"), "y", K.encode_coordinate("y", 0.25, 50.0).alias("raw_y"))


@query("quantise", on_points("select x, round(x / 25e-2) * 25e-2 as qx from points"))
def _(spark, d):
    return points(spark, d).select("x", K.quantise("x", 0.25).alias("qx"))


@query("coord_translate", on_points("select xi, x + 1e2 as x, y - 5e1 as y from points"))
def _(spark, d):
    return points(spark, d).select("xi", (c("x") + 100.0).alias("x"), (c("y") - 50.0).alias("y"))


@query("saturating_cast", on_points("""select x, cast(least(greatest(round(x), -128), 127) as smallint) as i8, cast(least(greatest(round(x), 0), 255) as smallint) as u8, cast(least(greatest(round(x), 0), 65535) as integer) as u16 from points"""))
def _(spark, d):
    return points(spark, d).select("x", K.saturating_cast("x", "int8").alias("i8"), K.saturating_cast("x", "uint8").alias("u8"), K.saturating_cast("x", "uint16").alias("u16"))


# Header statistics ------------------------------------------------------------------------------------------------


@query("header_bbox", on_points("select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z, count(*) as number_of_point_records from points"))
def _(spark, d):
    return stats.bounds(points(spark, d))


@query("bbox_midpoint", on_points("select 0.5e0*(max(x)+min(x)) as mid_x, 0.5e0*(max(y)+min(y)) as mid_y, 0.5e0*(max(z)+min(z)) as mid_z from points"))
def _(spark, d):
    return stats.midpoints(points(spark, d))


def _offsets(spark, d, rounding, left):
    return stats.bounds(points(spark, d)).select(*[K.updated_offset(f"min_{a}", f"max_{a}", rounding, left).alias(f"{a}_offset") for a in "xyz"])


_MID = "0.5e0*(max({0})+min({0}))"
query("update_offsets_mid", on_points("select " + ", ".join(f"round({_MID.format(a)} / 1e1) * 1e1 as {a}_offset" for a in "xyz") + " from points"))(lambda s, d: _offsets(s, d, 10.0, False))
query("update_offsets_left", on_points("select " + ", ".join(f"floor(min({a}) / 1e1) * 1e1 as {a}_offset" for a in "xyz") + " from points"))(lambda s, d: _offsets(s, d, 10.0, True))
query("update_offsets_none", on_points("select " + ", ".join(f"{_MID.format(a)} as {a}_offset" for a in "xyz") + " from points"))(lambda s, d: _offsets(s, d, 0.0, False))


@query("optimize_scale", on_points("select " + ", ".join(f"greatest(abs(min({a}) - 5e1), abs(max({a}) - 5e1)) / 2147483647e0 as scale_factor_{a}" for a in "xyz") + " from points"))
def _(spark, d):
    return stats.bounds(points(spark, d)).select(*[K.optimal_scale(f"min_{a}", f"max_{a}", lit(50.0)).alias(f"scale_factor_{a}") for a in "xyz"])


@query("bbox_max_distance", on_points("select " + ", ".join(f"greatest(abs(min({a}) - 5e1), abs(max({a}) - 5e1)) as far_{a}" for a in "xyz") + " from points"))
def _(spark, d):
    return stats.farthest(stats.bounds(points(spark, d)), dict.fromkeys("xyz", 50.0))


for _n in (5, 15):
    query(f"points_by_return_{_n}", on_points(f"select cast(r.range as integer) as return_number, count(p.return_number) as points from range(1, {_n + 1}) r left join points p on p.return_number = r.range group by 1"))(
        lambda s, d, n=_n: stats.returns(points(s, d), "return_number", n)
    )


@query("exact_mean", on_points("select cast(sum(xi) as double) / count(xi) * 1e-2 + 0e0 as mean_x, cast(sum(yi) as double) / count(yi) * 1e-2 + 0e0 as mean_y from points"))
def _(spark, d):
    return points(spark, d).agg(stats.exact_mean("xi", 0.01, 0.0).alias("mean_x"), stats.exact_mean("yi", 0.01, 0.0).alias("mean_y"))


@query("mean_diff", on_points("select xi, cast(round((x - (select cast(sum(xi) as double) / count(*) * 1e-2 from points)) * 1e3) as bigint) as dx_mm from points"))
def _(spark, d):
    p = points(spark, d)
    mean = p.agg(stats.exact_mean("xi", 0.01, 0.0).alias("m"))
    return p.crossJoin(F.broadcast(mean)).select("xi", F.round((c("x") - c("m")) * 1000).cast("long").alias("dx_mm"))


# Bit fields -------------------------------------------------------------------------------------------------------


def _bit_sql(col: str, fields) -> str:
    return ", ".join(f"({col} >> {at}) & {2**w - 1} as {n}" for n, at, w in fields)


@query("bits_decode_legacy", on_points(f"select bits, {_bit_sql('bits', K.LEGACY_BITS)} from points"))
def _(spark, d):
    return points(spark, d).select("bits", *K.decode_fields("bits", K.LEGACY_BITS))


@query("bits_encode_legacy", on_points("select return_number, scan_dir, edge, (return_number & 7) | (7 << 3) | ((scan_dir & 1) << 6) | ((edge & 1) << 7) as packed from points"))
def _(spark, d):
    return points(spark, d).select("return_number", "scan_dir", "edge", c("bits").alias("packed"))


@query("bits_decode_ext", f"select b1, b2, {_bit_sql('b1', K.EXTENDED_BITS)}, {_bit_sql('b2', K.EXTENDED_BITS2)} from (select cast(event_id % 256 as integer) as b1, cast(user_id % 256 as integer) as b2 from events)")
def _(spark, d):
    e = read(spark, d, "events").select((c("event_id") % 256).cast("int").alias("b1"), (c("user_id") % 256).cast("int").alias("b2"))
    return e.select("b1", "b2", *K.decode_fields("b1", K.EXTENDED_BITS), *K.decode_fields("b2", K.EXTENDED_BITS2))


@query("bits_encode_ext", "select event_id, cast(user_id & 15 as integer) | (cast((event_id // 7) & 15 as integer) << 4) as packed from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", K.encode_fields({"return_number": "user_id", "number_of_returns": F.floor(c("event_id") / 7)}, K.EXTENDED_BITS).alias("packed"))


@query("class_decode", f"select b, {_bit_sql('b', K.LEGACY_CLASS)} from (select cast(event_id % 256 as integer) as b from events)")
def _(spark, d):
    e = read(spark, d, "events").select((c("event_id") % 256).cast("int").alias("b"))
    return e.select("b", *K.decode_fields("b", K.LEGACY_CLASS))


@query("scan_angle", "select a, case when a % 2 = 0 then cast(a as double) * 6e-3 else cast(a as double) end as degrees from (select cast(event_id % 20000 - 10000 as integer) as a from events)")
def _(spark, d):
    e = read(spark, d, "events").select((c("event_id") % 20000 - 10000).cast("int").alias("a"))
    return e.select("a", K.scan_angle_degrees("a", F.when(c("a") % 2 == 0, 6).otherwise(0)).alias("degrees"))


@query("global_encoding_decode", f"select g, {_bit_sql('g', K.ENCODING)} from (select cast(o_orderkey % 65536 as integer) as g from orders)")
def _(spark, d):
    o = read(spark, d, "orders").select((c("o_orderkey") % 65536).cast("int").alias("g"))
    return o.select("g", *K.decode_fields("g", K.ENCODING))


@query("global_encoding_encode", "select g, g as packed from (select cast(o_orderkey % 65536 as integer) as g from orders)")
def _(spark, d):
    o = read(spark, d, "orders").select((c("o_orderkey") % 65536).cast("int").alias("g"))
    return o.select("g", *K.decode_fields("g", K.ENCODING)).select("g", K.encode_fields({n: n for n, _, _ in K.ENCODING}, K.ENCODING).alias("packed"))


@query("gps_time_text", "select g, case when g & 1 = 1 then 'Adjusted Standard GPS Time' else 'GPS Time of Week' end as gps_text from (select cast(o_orderkey % 65536 as integer) as g from orders)")
def _(spark, d):
    o = read(spark, d, "orders").select((c("o_orderkey") % 65536).cast("int").alias("g"))
    return o.select("g", K.gps_time_text("g").alias("gps_text"))


# Formats ----------------------------------------------------------------------------------------------------------

_INFO = "pdrf int, has_16bit_angle boolean, has_bits2 boolean, has_time boolean, has_color boolean, has_nir boolean, has_wavepackets boolean, base_length int, version_minor int"
_INFO_ROWS = """(0,false,false,false,false,false,false,20,3),(1,false,false,true,false,false,false,28,3),(2,false,false,false,true,false,false,26,3),(3,false,false,true,true,false,false,34,3),
(4,false,false,true,false,false,true,57,3),(5,false,false,true,true,false,true,63,3),(6,true,true,true,false,false,false,30,4),(7,true,true,true,true,false,false,36,4),
(8,true,true,true,true,true,false,38,4),(9,true,true,true,false,false,true,59,4),(10,true,true,true,true,true,true,67,4)"""


@query("record_format_info", f"select * from (values {_INFO_ROWS}) t({', '.join(x.split()[0] for x in _INFO.split(', '))})")
def _(spark, d):
    return spark.createDataFrame(formats.record_format_info(), _INFO)


@query("optimal_format", "select cast(range as integer) as pdrf, cast(range as integer) as optimal from range(0, 11)")
def _(spark, d):
    rows = [(k, formats.optimal_format({f[0] for f in formats.layout(k)}, wide_angle=k >= 6)) for k in PDRFS]
    return spark.createDataFrame(rows, "pdrf int, optimal int")


def _as_format(p: DataFrame, pdrf: int) -> DataFrame:
    """The derived points with the columns of a format, all of them filled."""
    p = p.select(F.lit(0).cast("long").alias("point_index"), *[n for n, _, _ in formats.layout(pdrf)])
    return cloud.convert_format(p, pdrf)


@query("format_upcast", on_points("select x, cast(intensity as integer) as intensity, cast(classification as smallint) as classification, cast(0 as smallint) as bits2, gps_time, cast(0 as integer) as red, cast(0 as integer) as nir from points"))
def _(spark, d):
    """Points of format 1 as those of format 8: fields that they lack are zero."""
    return cloud.convert_format(_as_format(points(spark, d), 1), 8).select("x", "intensity", "classification", "bits2", "gps_time", "red", "nir")


# Header rules -----------------------------------------------------------------------------------------------------

# Id, minor, major, header size, offset, format, record length, count, file size.
_BROKEN = [
    (0, 2, 1, 227, 227, 0, 20, 10, 427), (1, 5, 1, 375, 375, 6, 30, 10, 675), (2, 2, 1, 227, 100, 0, 20, 10, 427), (3, 2, 1, 227, 227, 11, 20, 10, 427), (4, 2, 1, 227, 227, 128, 20, 10, 427),
    (5, 2, 2, 227, 227, 0, 20, 10, 427), (6, 2, 1, 227, 227, 3, 20, 10, 427), (7, 2, 1, 227, 227, 0, 20, 1000, 427), (8, 2, 1, 227, 227, 0, 20, 0, 427), (9, 2, 1, 227, 227, 11, 0, 10, 427), (10, 2, 1, 227, 9999, 0, 20, 10, 427),
]
_LEN_SQL = "case format when 0 then 20 when 1 then 28 when 2 then 26 when 3 then 34 when 4 then 57 when 5 then 63 when 6 then 30 when 7 then 36 when 8 then 38 when 9 then 59 else 67 end"


@query("header_validate", f"""
with h as (select * from (values {', '.join(map(str, _BROKEN))}) t(id, minor, major, header_size, "offset", format, length, n, file_size)),
r as (select id, file_size, "offset", length, n, format,
  case when "offset" < header_size then 3 when format > 127 then 5 when major <> 1 then 6 when format <= 10 and length < {_LEN_SQL} then 7 when length < 14 then 11 when "offset" > file_size then 12
       when (file_size - "offset") // nullif(length, 0) < n then 9 when n < 1 then 10 end as reject, minor, header_size from h)
select id, 2 as rule, 'warn' as effect from r where minor > 4
union all select id, 4, 'degrade' from r where format > 10 and coalesce(reject, 99) <> 3
union all select id, 8, 'degrade' from r where format > 10 and coalesce(reject, 99) not in (3, 5, 6, 7)
union all select id, reject, 'reject' from r where reject is not null""")
def _(spark, d):
    rows = []
    for i, minor, major, size, offset, pdrf, length, n, file_size in _BROKEN:
        h = headers.default(0, minor if minor <= 4 else 4) | {"version_minor": minor, "version_major": major, "header_size": size, "offset_to_point_data": offset, "point_data_format": pdrf, "point_data_record_length": length, "number_of_point_records": n}
        rows += [(i, f.rule, f.effect) for f in headers.check(h, file_size)]
    return spark.createDataFrame(rows, "id int, rule int, effect string")


# Records ----------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a record of its own file, repeated so that some pass the limit of a plain record."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", lit("")), r"[^\x00-\xff]", "?"), "\r", "")
    return read(spark, d, "documents").select(c("doc_id").alias("file_id"), F.encode(F.repeat(text, 5), "ISO-8859-1").alias("data"))


_DOC_SQL = "docs as (select doc_id as file_id, length(repeat(replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x{ff}]', '?', 'g'), chr(13), ''), 5)) as n from documents)"


@query("text_payload_len", f"with {_DOC_SQL} select file_id, n as payload_length from docs")
def _(spark, d):
    return _documents(spark, d).select("file_id", F.length("data").cast("long").alias("payload_length"))


@query("vlr_promote", f"with {_DOC_SQL} select n > 65535 as is_extended, count(*) as records from docs group by 1")
def _(spark, d):
    return _documents(spark, d).select(records.is_long("data").alias("is_extended")).groupBy("is_extended").agg(F.count(lit(1)).alias("records"))


@query("vlr_upsert", f"""with {_DOC_SQL},
old as (select file_id, file_id % 3 = 0 as is_extended, cast(k.range as integer) as idx, case when k.range = 1 then 3 else 100 + k.range end as record_id from docs, range(0, 3) k),
has as (select file_id, bool_or(is_extended) as ext from old where record_id = 3 group by 1)
select file_id, is_extended, idx, cast(record_id as integer) as record_id from old where record_id <> 3
union all select d.file_id, d.n > 65535, case when (d.n > 65535) = has.ext then 1 else 0 end, 3 from docs d join has using (file_id)""")
def _(spark, d):
    docs = checkpoint(_documents(spark, d))
    k = F.explode(F.array(*[lit(i) for i in range(3)]))
    old = docs.select("file_id", (c("file_id") % 3 == 0).alias("is_extended"), k.alias("idx")).select(
        "file_id", "is_extended", "idx", lit(0).alias("reserved"), lit("LASF_Spec").alias("user_id"), F.when(c("idx") == 1, 3).otherwise(100 + c("idx")).alias("record_id"),
        lit(0).cast("long").alias("record_length"), lit("").alias("description"), F.lit(bytearray()).alias("data"), lit("").alias("data_as_text"),
    )
    new = docs.select("file_id", lit("LASF_Spec").alias("user_id"), lit(3).alias("record_id"), lit("Text Area Description").alias("description"), "data")
    return records.upsert(old, new, ["file_id"]).select("file_id", "is_extended", "idx", "record_id")


@query("vlr_exists", "select file_id, bool_or(record_id = 4 and user_id = 'LASF_Spec') as has_extra_bytes from vlr group by file_id")
def _(spark, d):
    return read(spark, d, "vlr").groupBy("file_id").agg(F.bool_or((c("record_id") == 4) & (c("user_id") == "LASF_Spec")).alias("has_extra_bytes"))


# Extra bytes ------------------------------------------------------------------------------------------------------


def _normals(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", *[F.round(c("embedding")[i].cast("double") * 1000).cast("int").alias(f"k{i}") for i in range(3)])
    return e.select("vec_id", *[F.greatest(F.least(c(f"k{i}") / 1000.0, lit(1.0)), lit(-1.0)).alias(f"v{'XYZ'[i]}") for i in range(3)])


_NORMAL_SQL = "n as (select vec_id, " + ", ".join(f"greatest(least(cast(round(cast(embedding[{i + 1}] as double) * 1000) as integer) / 1e3, 1e0), -1e0) as v{'XYZ'[i]}" for i in range(3)) + " from embeddings)"


def _normal_fields(kind: str) -> extrabytes.ExtraBytes:
    eb = extrabytes.ExtraBytes.of(["vX", "vY", "vZ"]).set_type(["vX", "vY", "vZ"], kind)
    return eb.set_scale(eb.names, 1 / 32767).set_bit(eb.names, extrabytes.SCALE, True) if kind == "int16" else eb


def _packed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return extrabytes.encode(_normals(spark, d), _normal_fields(kind))


_RAW16 = ", ".join(f"cast(trunc(v{a} / (1e0/32767e0) + (case when v{a} < 0 then -0.5e0 else 0.5e0 end)) as integer) as r{a}" for a in "XYZ")


@query("extrabytes_encode_int16", f"with {_NORMAL_SQL} select vec_id, 6 as bytes, {_RAW16} from n")
def _(spark, d):
    raw = extrabytes.ExtraBytes.of(["rX", "rY", "rZ"]).set_type(["rX", "rY", "rZ"], "int16")
    p = _packed(spark, d, "int16")
    return extrabytes.decode(p, raw, keep=True).select("vec_id", F.length("extradata").alias("bytes"), *[c(f"r{a}").cast("int").alias(f"r{a}") for a in "XYZ"])


@query("extrabytes_decode", f"with {_NORMAL_SQL}, r as (select vec_id, {_RAW16} from n) select vec_id, " + ", ".join(f"cast(r{a} as double) * (1e0/32767e0) as v{a}" for a in "XYZ") + " from r")
def _(spark, d):
    return extrabytes.decode(_packed(spark, d, "int16"), _normal_fields("int16")).select("vec_id", "vX", "vY", "vZ")


@query("extrabytes_single", f"with {_NORMAL_SQL} select vec_id, " + ", ".join(f"cast(v{a} as float) as v{a}" for a in "XYZ") + " from n")
def _(spark, d):
    return extrabytes.decode(_packed(spark, d, "single"), _normal_fields("single")).select("vec_id", "vX", "vY", "vZ")


@query("extrabytes_stats", f"with {_NORMAL_SQL}, r as (select vec_id, {_RAW16} from n) select " + ", ".join(f"min(cast(r{a} as double) * (1e0/32767e0)) as min_v{a}, max(cast(r{a} as double) * (1e0/32767e0)) as max_v{a}" for a in "XYZ") + " from r")
def _(spark, d):
    return extrabytes.field_ranges(extrabytes.decode(_packed(spark, d, "int16"), _normal_fields("int16")), ["vX", "vY", "vZ"])


@query("max_deviation", f"with {_NORMAL_SQL}, r as (select *, {_RAW16} from n) select max(greatest(" + ", ".join(f"abs(v{a} - cast(r{a} as double) * (1e0/32767e0))" for a in "XYZ") + ")) as deviation from r")
def _(spark, d):
    n = _normals(spark, d)
    both = extrabytes.decode(extrabytes.encode(n.select("*", *[c(f"v{a}").alias(f"o{a}") for a in "XYZ"]), _normal_fields("int16")), _normal_fields("int16"))
    return both.agg(stats.max_deviation([(f"v{a}", f"o{a}") for a in "XYZ"]).alias("deviation"))


# Polygons ---------------------------------------------------------------------------------------------------------

#: A ring of 64 vertices on whole coordinates.
RING = [(round(45000 + 20000 * math.sin(2 * math.pi * k / 64)), round(25 + 20 * math.cos(2 * math.pi * k / 64))) for k in range(1, 65)]
RING_X, RING_Y = [float(x) for x, _ in RING], [float(y) for _, y in RING]
#: Three rings that overlap, the second wound twice.
POLYGONS = {1: ([10000.0, 40000.0, 40000.0, 10000.0], [5.0, 5.0, 30.0, 30.0]), 2: ([30000.0, 60000.0, 60000.0, 30000.0] * 2, [10.0, 10.0, 45.0, 45.0] * 2), 3: ([20000.0, 80000.0, 50000.0], [1.0, 20.0, 49.0])}


def _edges_sql(rings: dict[int, tuple[list[float], list[float]]]) -> str:
    rows = [f"({k}, {xs[i - 1]!r}e0, {ys[i - 1]!r}e0, {xs[i]!r}e0, {ys[i]!r}e0)" for k, (xs, ys) in rings.items() for i in range(len(xs))]
    return f"e as (select * from (values {', '.join(rows)}) t(poly_id, x1, y1, x2, y2))"


_SIDE = "((y - y1) * (x2 - x1) - (x - x1) * (y2 - y1))"
_TURN = f"case when y1 <= y and y2 > y and {_SIDE} > 0 then 1 when y1 > y and y2 <= y and {_SIDE} < 0 then -1 else 0 end"
_IDS = "q as (select *, row_number() over () as rid from points)"
_KEEP = "xi, yi"


def _pip_sql(condition: str, negate: bool = False) -> str:
    return on_points(f", {_IDS}, {_edges_sql({0: (RING_X, RING_Y)})}, w as (select rid, any_value(xi) as xi, any_value(yi) as yi, {condition} as hit from q cross join e group by rid) select xi, yi from w where {'not ' if negate else ''}hit")


_WIND = f"sum({_TURN}) <> 0"
_EDGE = f"(sum({_TURN}) <> 0 or bool_or(x = x2 and y = y2) or bool_or((y1 > y) <> (y2 > y) and {_SIDE} = 0))"
_CAST = "sum(case when (y2 > y) <> (y1 > y) and x < (x1 - x2) * (y - y2) / nullif(y1 - y2, 0) + x2 then 1 else 0 end) % 2 = 1"


@query("pip_winding", _pip_sql(_WIND))
def _(spark, d):
    return spatial.select_inside(points(spark, d), RING_X, RING_Y).select("xi", "yi")


@query("pip_edges", _pip_sql(_EDGE))
def _(spark, d):
    return spatial.select_inside(points(spark, d), RING_X, RING_Y, algorithm=spatial.WINDING_EDGES).select("xi", "yi")


@query("pip_raycast", _pip_sql(_CAST))
def _(spark, d):
    return spatial.select_inside(points(spark, d), RING_X, RING_Y, algorithm=spatial.RAYCAST).select("xi", "yi")


@query("pip_outside", _pip_sql(_WIND, True))
def _(spark, d):
    return spatial.select_outside(points(spark, d), RING_X, RING_Y).select("xi", "yi")


@query("pip_edge_join", _pip_sql(_WIND))
def _(spark, d):
    p = points(spark, d).groupBy("xi", "yi", "x", "y").agg(F.count(lit(1)).alias("n")).withColumn("id", F.struct("xi", "yi", "n"))
    w = spatial.winding_by_edges(p, "id", RING_X, RING_Y)
    return w.select("id.xi", "id.yi", F.explode(F.array_repeat(lit(0), c("id.n").cast("int"))).alias("_")).drop("_")


@query("pip_inside_count", on_points(f", {_IDS}, {_edges_sql({0: (RING_X, RING_Y)})}, w as (select rid, {_WIND} as hit from q cross join e group by rid) select count(*) filter (hit) as inside, count(*) as points from w"))
def _(spark, d):
    return points(spark, d).agg(F.count_if(spatial.is_inside("x", "y", RING_X, RING_Y)).alias("inside"), F.count(lit(1)).alias("points"))


@query("pip_all_equal", on_points(f", {_IDS}, {_edges_sql({0: (RING_X, RING_Y)})}, w as (select rid, {_WIND} as wind, {_EDGE} as edge, {_CAST} as ray from q cross join e group by rid) select count(*) filter (wind <> edge) as wind_edge, count(*) filter (wind <> ray) as wind_ray, count(*) filter (wind) as inside, bool_and(wind = ray) as all_equal from w"))
def _(spark, d):
    """How many points the three algorithms judge differently; the ring's direction changes none."""
    a, b, r = (spatial.is_inside("x", "y", RING_X[::s], RING_Y[::s], k) for k, s in ((0, 1), (1, 1), (2, -1)))
    return points(spark, d).select(a.alias("a"), b.alias("b"), r.alias("r")).agg(F.count_if(c("a") != c("b")).alias("wind_edge"), F.count_if(c("a") != c("r")).alias("wind_ray"), F.count_if("a").alias("inside"), F.bool_and(c("a") == c("r")).alias("all_equal"))


_MULTI = f", {_IDS}, {_edges_sql(POLYGONS)}, w as (select rid, any_value(xi) as xi, any_value(yi) as yi, poly_id, {_WIND} as hit from q cross join e group by rid, poly_id)"


@query("pip_multi_semi", on_points(f"{_MULTI} select any_value(xi) as xi, any_value(yi) as yi from w group by rid having bool_or(hit)"))
def _(spark, d):
    return points(spark, d).where(F.size(spatial.containing("x", "y", POLYGONS)) > 0).select("xi", "yi")


@query("pip_multi_anti", on_points(f"{_MULTI} select any_value(xi) as xi, any_value(yi) as yi from w group by rid having not bool_or(hit)"))
def _(spark, d):
    return points(spark, d).where(F.size(spatial.containing("x", "y", POLYGONS)) == 0).select("xi", "yi")


@query("pip_counts", on_points(f"{_MULTI} select poly_id, count(*) as inside from w where hit group by poly_id"))
def _(spark, d):
    return points(spark, d).select(F.explode(spatial.containing("x", "y", POLYGONS)).alias("poly_id")).groupBy("poly_id").agg(F.count(lit(1)).alias("inside"))


def _table_of(spark: SparkSession, rings: dict[int, tuple[list[float], list[float]]]) -> DataFrame:
    return spark.createDataFrame([(k, i, x, y) for k, (xs, ys) in rings.items() for i, (x, y) in enumerate(zip(xs, ys))], "poly_id long, seq int, x double, y double")


def _pip_table(spark: SparkSession, d: str, algorithm: int) -> DataFrame:
    """Pairs of a table of polygons and the places inside, without Python."""
    p = points(spark, d).withColumn("id", c("xi") * 10_000 + c("yi"))
    found = proximity.points_in_polygons(p, _table_of(spark, POLYGONS), "id", algorithm=algorithm)
    return found.select("poly_id", F.floor(c("id") / 10_000).cast("long").alias("xi"), (c("id") % 10_000).alias("yi"))


for _name, _algorithm, _how in (("winding", 0, _WIND), ("edges", 1, _EDGE), ("raycast", 2, _CAST), ("unknown_algorithm", 7, _WIND)):
    query(f"pip_table_{_name}", on_points(f", q as (select distinct xi, yi, x, y from points), {_edges_sql(POLYGONS)} select poly_id, xi, yi from q cross join e group by poly_id, xi, yi having {_how}"))(
        lambda s, d, a=_algorithm: _pip_table(s, d, a)
    )



@query("pip_single_precision", on_points(f", {_IDS}, {_edges_sql({0: (RING_X, RING_Y)})}, f as (select rid, xi, yi, cast(x as float) as x, cast(y as float) as y, cast(x1 as float) as x1, cast(y1 as float) as y1, cast(x2 as float) as x2, cast(y2 as float) as y2 from q cross join e), w as (select rid, any_value(xi) as xi, any_value(yi) as yi, {_WIND} as hit from f group by rid) select xi, yi from w where hit"))
def _(spark, d):
    return points(spark, d).where(spatial.is_inside("x", "y", RING_X, RING_Y, single=True)).select("xi", "yi")


@query("pip_unknown_algorithm", _pip_sql(_WIND))
def _(spark, d):
    return spatial.select_inside(points(spark, d), RING_X, RING_Y, algorithm=9).select("xi", "yi")


@query("near_on_earth", """
with p as (select c_custkey as id, (c_custkey * 7919 % 36000) / 1e2 - 18e1 as lon, (c_custkey * 104729 % 18000) / 1e2 - 9e1 as lat from customer)
select a.id as id_a, b.id as id_b from p a join p b on a.id < b.id and abs(a.lat - b.lat) <= 5e-1
where 2 * 6371008.8e0 * asin(least(sqrt(pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)), 1e0)) <= 5e4""")
def _(spark, d):
    p = read(spark, d, "customer").select(c("c_custkey").alias("id"), ((c("c_custkey") * 7919 % 36000) / 100.0 - 180.0).alias("lon"), ((c("c_custkey") * 104729 % 18000) / 100.0 - 90.0).alias("lat"))
    return proximity.near_on_earth(p, 50_000.0)


@query("circle_vertices", "select cast(range as integer) as k, cast(round((45e3 + 2e4 * sin(2 * pi() * range / 64)) * 1e3) as bigint) as x_mm, cast(round((25e0 + 2e1 * cos(2 * pi() * range / 64)) * 1e3) as bigint) as y_mm from range(1, 65)")
def _(spark, d):
    xs, ys = spatial.circle(45000.0, 25.0, 20000.0, 64)
    _, ys = spatial.circle(45000.0, 25.0, 20.0, 64)
    return spark.createDataFrame([(k + 1, round(float(x) * 1000), round(float(y) * 1000)) for k, (x, y) in enumerate(zip(xs, ys))], "k int, x_mm long, y_mm long")


# Files ------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder that all executors share: the checkpoint folder, or in tests one of this machine."""
    base = las.local(shared_folder(spark).replace("file:///", "file:/"))
    if "://" in base:
        raise ValueError("files are written to mounted folders only")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="las", dir=base)


def _written(spark: SparkSession, d: str, pdrf: int) -> str:
    path = os.path.join(_folder(spark), f"points{pdrf}.las")
    p = _as_format(points(spark, d), pdrf).withColumn("point_index", F.monotonically_increasing_id())
    text = "Area of the test points"
    start = cloud.PointCloud(p, headers.default(pdrf) | {f"scale_factor_{a}": 0.01 for a in "xyz"}, cloud.no_records(spark))
    cloud.write_cloud(cloud.add_text_area(start, text), path, pdrf, ordered=True)  # ids follow the order of rows
    return path


def _roundtrip_sql(pdrf: int) -> str:
    columns = [f"cast({n} as {'integer' if t.simpleString() == 'int' else t.simpleString()}) as {n}" for n, _, t in formats.layout(pdrf)]
    return on_points(f"select {', '.join(columns)} from points")


def _read_back(spark: SparkSession, d: str, pdrf: int, **options: str) -> DataFrame:
    las.register(spark)
    return spark.read.format("las").options(**options).load(_written(spark, d, pdrf))


for _k in PDRFS:
    query(f"las_roundtrip_pdrf{_k}", _roundtrip_sql(_k))(lambda s, d, k=_k: _read_back(s, d, k).drop("point_index"))


@query("las_scan_xyzi", on_points("select x, y, z, intensity from points"))
def _(spark, d):
    return _read_back(spark, d, 7, columns="x,y,z,intensity").drop("point_index")


@query("las_header", on_points("select cast(3 as smallint) as point_data_format, 34 as point_data_record_length, cast(count(*) as decimal(20,0)) as number_of_point_records, cast(1 as bigint) as number_of_variable_records, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z, 3 as version_minor, 235 as header_size, cast(312 as bigint) as offset_to_point_data, 1e-2 as scale_factor_x, 1e-2 as scale_factor_z, 0e0 as y_offset from points"))
def _(spark, d):
    h = _read_back(spark, d, 3, part="header")
    return h.select(
        "point_data_format", "point_data_record_length", "number_of_point_records", "number_of_variable_records", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", c("version_minor").cast("int").alias("version_minor"),
        c("header_size").cast("int").alias("header_size"), c("offset_to_point_data").cast("long").alias("offset_to_point_data"), "scale_factor_x", "scale_factor_z", "y_offset",
    )


@query("las_vlr", "select false as is_extended, 0 as idx, 'LASF_Spec' as user_id, 3 as record_id, cast(23 as bigint) as record_length, 'Text Area Description' as description, 'Area of the test points' as data_as_text")
def _(spark, d):
    return _read_back(spark, d, 0, part="vlr").select("is_extended", "idx", "user_id", "record_id", "record_length", "description", "data_as_text")


@query("las_scan_folder", on_points("select count(*) as points, cast(sum(xi) as bigint) as sum_x from points"))
def _(spark, d):
    """Written as a folder of whole files, one for each task, and read as one table."""
    las.register(spark)
    path = os.path.join(_folder(spark), "strips")
    _as_format(points(spark, d), 1).drop("point_index").write.format("las").options(pdrf="1", layout="folder", header='{"scale_factor_x": 0.01, "scale_factor_y": 0.01, "scale_factor_z": 0.01}').mode("overwrite").save(path)
    p = spark.read.format("las").load(path)
    return p.agg(F.count(lit(1)).alias("points"), F.sum(F.round(c("x") * 100).cast("long")).alias("sum_x"))


@query("las_equal", on_points(", q as (select *, case when classification = 3 then intensity + 1 else intensity end as other from points), a as (select x, y, z, intensity, bits, point_source_id from q), b as (select x, y, z, other, bits, point_source_id from q) select (select count(*) from (select * from a except all select * from b)) > 0 as differs, (select count(*) from points) as points, true as equal"))
def _(spark, d):
    """A cloud read back equals what was written, and doesn't equal one with other intensities in a class."""
    p = _as_format(points(spark, d), 3).drop("point_index").where("intensity < 65535")
    back = _read_back(spark, d, 3)
    other = p.withColumn("intensity", F.when(c("classification") == 3, c("intensity") + 1).otherwise(c("intensity")))
    return spark.createDataFrame([(not cloud.same(other, back, ignore=("point_index",)), back.count(), cloud.same(p, back, ignore=("point_index",)))], "differs boolean, points long, equal boolean")


WKT_SQL = "repeat('é', 70000)"


def _with_wkt(spark: SparkSession, d: str) -> str:
    path = os.path.join(_folder(spark), "wkt.las")
    p = _as_format(points(spark, d), 6).withColumn("point_index", F.monotonically_increasing_id())
    start = cloud.PointCloud(p, headers.default(6) | {f"scale_factor_{a}": 0.01 for a in "xyz"}, cloud.no_records(spark))
    cloud.write_cloud(cloud.add_wkt(cloud.add_text_area(start, "naïve Größe"), "é" * 70_000), path, 6, ordered=True)
    return path


@query("las_evlr", f"select false as is_extended, 0 as idx, 'LASF_Spec' as user_id, 3 as record_id, cast(11 as bigint) as record_length, 'naïve Größe' as data_as_text union all select true, 0, 'LASF_Projection', 2112, 70000, {WKT_SQL}")
def _(spark, d):
    las.register(spark)
    return spark.read.format("las").option("part", "vlr").load(_with_wkt(spark, d)).select("is_extended", "idx", "user_id", "record_id", "record_length", "data_as_text")


@query("las_wkt", on_points("select 16 as global_encoding, 440 as offset_to_point_data, cast(1 as bigint) as number_of_extended_variable_length_record, cast(440 + 30 * count(*) as decimal(20,0)) as start_of_extended_variable_length_record, cast(0 as bigint) as legacy_number_of_point_records from points"))
def _(spark, d):
    las.register(spark)
    h = spark.read.format("las").option("part", "header").load(_with_wkt(spark, d))
    return h.select(c("global_encoding").cast("int").alias("global_encoding"), c("offset_to_point_data").cast("int").alias("offset_to_point_data"), "number_of_extended_variable_length_record", "start_of_extended_variable_length_record", "legacy_number_of_point_records")


for _k, _mask, _bins in ((3, 7, 5), (8, 15, 15)):
    query(f"las_by_return_pdrf{_k}", on_points(f"select cast(r.range as integer) as return_number, cast(count(p.bits) as bigint) as points from range(1, {_bins + 1}) r left join points p on (p.bits & {_mask}) = r.range group by 1"))(
        lambda s, d, k=_k: _read_back(s, d, k, part="header").select(F.posexplode("number_of_points_by_return").alias("at", "n")).select((c("at") + 1).cast("int").alias("return_number"), c("n").cast("long").alias("points"))
    )


def _extra_cloud(spark: SparkSession, d: str) -> cloud.PointCloud:
    """Normals packed into the extra bytes of points, written and read again."""
    n = _normals(spark, d)
    p = n.select(c("vec_id").cast("long").alias("point_index"), *[c(f"v{a}").alias(a.lower()) for a in "XYZ"], *[lit(0).cast(t).alias(m) for m, _, t in formats.layout(1)[3:]], "vX", "vY", "vZ")
    fields = _normal_fields("int16").set_description(["vX", "vY", "vZ"], "surface normal")
    packed = cloud.encode_extrabytes(cloud.PointCloud(p, headers.default(1), cloud.no_records(spark)), fields)
    return cloud.write_cloud(packed, os.path.join(_folder(spark), "normals.las"), 1)


@query("las_extrabytes", f"with {_NORMAL_SQL}, r as (select vec_id, {_RAW16} from n) select cast(row_number() over (order by vec_id) - 1 as bigint) as point_index, " + ", ".join(f"cast(r{a} as double) * (1e0/32767e0) as v{a}" for a in "XYZ") + " from r")
def _(spark, d):
    return cloud.decode_extrabytes(_extra_cloud(spark, d)).select("point_index", "vX", "vY", "vZ")


@query("las_extra_fields", "select 'v' || a as name, 'surface normal' as description, 'int16' as data_type, 8 as options, 1e0 / 32767e0 as scale, 0e0 as \"offset\" from (values ('X'), ('Y'), ('Z')) t(a)")
def _(spark, d):
    return cloud.extra_fields(_extra_cloud(spark, d)).descriptors(spark).select("name", "description", "data_type", "options", "scale", "offset")


@query("new_point_cloud", "select cast(0 as bigint) as points, 12 as columns")
def _(spark, d):
    new = cloud.new_point_cloud(spark)
    return new.points.agg(F.count(lit(1)).alias("points")).withColumn("columns", lit(len(new.points.columns)))


@query("allocate", "select cast(range as bigint) as point_index, 0e0 as x, cast(0 as smallint) as classification, 0e0 as gps_time, 0 as red from range(0, 1000)")
def _(spark, d):
    return cloud.allocate(spark, 1000, 3, 3).points.select("point_index", "x", "classification", "gps_time", "red")


@query("random_cloud", "select cast(1000 as bigint) as points, true as within")
def _(spark, d):
    p = cloud.random_cloud(spark, 1000, 10, seed=5).points
    ok = c("x").between(0, 1) & c("intensity").between(0, 65535) & c("bits").between(0, 255) & c("scan_angle").between(-32768, 32767) & c("wave_packet_size").between(0, 2**32 - 1)
    return p.agg(F.count(lit(1)).alias("points"), F.bool_and(ok).alias("within"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
