"""Schemas that drift between the files of a series.

The footer metadata of each file (point format, version, extra-byte descriptors) is exploded to one row for each
field; files are numbered within their series. For each series, field and type the islands of consecutive files
are found by lag and lead; an island's start and the file after its end are the events, which together give what
a file adds, drops, renames and retypes. Hot series are cut into blocks of files that overlap by one, so no
window grows with the series.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import scan_angle_degrees
from ..session import checkpoint, fitting
from ..sources.formats import EXTRA_TYPES, POINT_FIELDS, extra_bytes_size, fields_of
from ..sources.las import flat_bytes
from .extrabytes import OFFSET, SCALE, ExtraField, from_raw

DESCRIPTOR = 192
BLOCK = 4096
#: File ids of one part of a day.
FILE_RANGE = 65_536
VERSION_FIELDS = {
    3: ["start_of_waveform_data"],
    4: ["start_of_extended_variable_length_record", "number_of_extended_variable_length_record", "legacy_number_of_point_records", "legacy_number_of_points_by_return"],
}


def descriptors(vlr: DataFrame, scaling: bool = False) -> DataFrame:
    """(file_id, name, type, description, data_type, options, size, pos) of the extra-byte fields a file declares.

    Names and descriptions are cut at the first NUL, trimmed and lower-cased, in names each other character
    than a-z, 0-9 and _ becomes _. A field that repeated records declare again counts once. type is the name of
    the number type, or bytes[n] for type 0. scaling: also scale and offset, the doubles as hexadecimal text, empty
    where the option bit is not set.
    """
    text = lambda c: F.lower(F.trim(F.regexp_extract(F.decode(c, "ISO-8859-1"), r"(?s)^([^\x00]*)", 1)))
    byte = lambda c, at: F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("int")
    real = lambda at, bit: F.when((byte("d", 3) != 0) & (byte("d", 4).bitwiseAND(bit) != 0), F.hex(F.substring("d", at, 8))).otherwise("")
    more = ["scale", "offset"] if scaling else []
    d = (
        vlr.where("user_id = 'LASF_Spec' and record_id = 4 and file_id is not null and length(data) >= 192")
        .select("file_id", F.col("is_extended").cast("int").alias("ext"), "idx", "data")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.length("data") / DESCRIPTOR).cast("int") - 1)))
        .select("file_id", "ext", "idx", "k", F.substring(F.col("data"), F.col("k") * DESCRIPTOR + 1, F.lit(DESCRIPTOR)).alias("d"))
    )
    d = d.select("file_id", "ext", "idx", "k", F.regexp_replace(text(F.substring("d", 5, 32)), "[^a-z0-9_]", "_").alias("name"), byte("d", 3).alias("data_type"), byte("d", 4).alias("options"), text(F.substring("d", 161, 32)).alias("description"), *([real(113, SCALE).alias("scale"), real(137, OFFSET).alias("offset")] if scaling else []))
    names = F.create_map(*[F.lit(x) for k, (n, _) in EXTRA_TYPES.items() for x in (k, n)])
    kind = F.when(F.col("data_type") == 0, F.format_string("bytes[%d]", F.col("options"))).otherwise(F.coalesce(F.try_element_at(names, F.col("data_type")), F.format_string("type%d", F.col("data_type"))))
    size = F.when(F.col("data_type") == 0, F.col("options")).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (_, s) in EXTRA_TYPES.items() for x in (k, s)]), F.col("data_type")), F.lit(0)))
    first = d.groupBy("file_id", "name").agg(F.min(F.struct("ext", "idx", "k", "data_type", "options", "description", *more)).alias("s")).select("file_id", "name", "s.*")
    return first.select("file_id", "name", kind.alias("type"), "description", "data_type", "options", size.alias("size"), F.struct("ext", "idx", "k").alias("pos"), *more)


def _first_deliveries(header: DataFrame, *more: str) -> DataFrame:
    """(file_id, l, received_at, series, year, day, pdrf, minor and more): each file as it was first delivered."""
    first = F.struct(F.coalesce("load_id", F.lit(2**31 - 1)).alias("l"), "received_at", F.col("project_id_guid1").alias("series"), F.col("file_creation_year").alias("year"), F.col("file_creation_day_of_year").alias("day"), F.col("point_data_format").cast("int").alias("pdrf"), F.col("version_minor").cast("int").alias("minor"), *more)
    return header.where("file_id is not null").groupBy("file_id").agg(F.min(first).alias("s")).select("file_id", "s.*").where("pdrf between 0 and 10 and minor between 0 and 4")


def numbered_files(header: DataFrame) -> DataFrame:
    """(series, file_id, ord, is_last, pdrf, minor): each file once, numbered from 1 in its series.

    Numbers come from the place within a part of a day plus the files of earlier parts, so that no window holds a
    series or a day (files without a date are all of one day): parts are ranges of FILE_RANGE file ids.
    """
    f = _first_deliveries(header).select("file_id", "series", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("day", F.lit(0)).alias("day"), "pdrf", "minor").withColumn("part", F.floor(F.col("file_id") / FILE_RANGE))
    days = f.groupBy("series", "year", "day", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series").orderBy("year", "day", "part")
    days = days.select("series", "year", "day", "part", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("series")).alias("files"))
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("series", "year", "day", "part").orderBy("file_id")))
    on = [f[c].eqNullSafe(days[c]) for c in ("series", "year", "day", "part")]
    return f.join(days, on).select(f["series"], "file_id", (F.col("before") + F.col("place")).alias("ord"), (F.col("before") + F.col("place") == F.col("files")).alias("is_last"), "pdrf", "minor")


def file_fields(files: DataFrame, described: DataFrame) -> DataFrame:
    """(series, file_id, ord, is_last, name, type, description): one row for each field of each file."""
    base = F.create_map(*[x for k in range(11) for x in (F.lit(k), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in fields_of(k)]))])
    extra = lambda m: F.when(F.col("minor") >= m, F.array(*[F.struct(F.lit(n).alias("name"), F.lit("header").alias("type")) for n in VERSION_FIELDS[m]])).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    own = files.withColumn("f", F.explode(F.concat(F.try_element_at(base, F.col("pdrf")), extra(3), extra(4)))).select("series", "file_id", "ord", "is_last", "f.name", "f.type", F.lit("").alias("description"))
    declared = files.join(described, "file_id").select("series", "file_id", "ord", "is_last", "name", "type", "description")
    return own.unionByName(declared)


def _starts_and_ends(fields: DataFrame, edges: bool = False) -> DataFrame:
    """(series, ord, name, type, description, starts): ord is the file in which the island starts or is gone.

    edges: starts at a series' first file and ends after its last count as well.
    """
    keep = fields.withColumn("part", F.floor(F.col("ord") / BLOCK))
    # The last file of a block is also the first of the next one; it is judged there, except for its start.
    both = keep.withColumn("copy", F.explode(F.when((F.col("ord") + 1) % BLOCK == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.withColumn("part", F.col("part") + F.col("copy"))
    w = Window.partitionBy("series", "name", "type", "part").orderBy("ord")
    both = both.withColumns({"prev": F.lag("ord").over(w), "next": F.lead("ord").over(w)})
    start = (F.col("copy") == 0) & (F.lit(edges) | (F.col("ord") > 1)) & F.coalesce(F.col("prev") != F.col("ord") - 1, F.lit(True))
    split = ((F.col("ord") + 1) % BLOCK == 0) & (F.col("copy") == 0)
    end = ~split & (F.lit(edges) | ~F.col("is_last")) & F.coalesce(F.col("next") != F.col("ord") + 1, F.lit(True))
    events = F.array_compact(F.array(F.when(start, F.struct(F.col("ord").alias("at"), F.lit(True).alias("starts"))), F.when(end, F.struct((F.col("ord") + 1).alias("at"), F.lit(False).alias("starts")))))
    return both.select("series", "name", "type", "description", F.explode(events).alias("e")).select("series", F.col("e.at").alias("ord"), "name", "type", "description", "e.starts")


def changes(header: DataFrame, vlr: DataFrame) -> DataFrame:
    """(file_id, field, change_kind): added, removed, renamed and retyped against the file before in the series."""
    files = checkpoint(numbered_files(header))
    ev = _starts_and_ends(file_fields(files, descriptors(vlr)))
    # A field whose type changes ends and starts at one file, under one name; one row for each field remains.
    per = ev.groupBy("series", "ord", "name").agg(
        F.max(F.when(F.col("starts"), F.struct("type", "description"))).alias("new"), F.max(F.when(~F.col("starts"), F.struct("type", "description"))).alias("old")
    )
    per = checkpoint(per)  # a few rows for each change, read by five joins
    same = per.where("new is not null and old is not null").select("series", "ord", F.col("name").alias("field"), F.lit("retyped").alias("change_kind"))
    new = per.where("old is null").select("series", "ord", "name", F.col("new.type").alias("type"), F.col("new.description").alias("description"))
    gone = per.where("new is null").select("series", "ord", F.col("name").alias("old_name"), F.col("old.type").alias("old_type"), F.col("old.description").alias("description"))
    described = lambda d: d.where("description <> ''").withColumn("k", F.row_number().over(Window.partitionBy("series", "ord", "description").orderBy(d.columns[2])))
    nulls = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    n, g = described(new), described(gone)
    moved = n.join(g, nulls(n, g, "series", "ord", "description", "k")).select(n["series"], n["ord"], "name", "old_name", "type", "old_type")
    renamed = moved.select("series", "ord", F.col("name").alias("field"), F.explode(F.array_compact(F.array(F.lit("renamed"), F.when(F.col("type") != F.col("old_type"), F.lit("retyped"))))).alias("change_kind"))
    added = new.join(moved, [new["series"].eqNullSafe(moved["series"]), new["ord"] == moved["ord"], new["name"] == moved["name"]], "left_anti").select("series", "ord", F.col("name").alias("field"), F.lit("added").alias("change_kind"))
    removed = gone.join(moved, [gone["series"].eqNullSafe(moved["series"]), gone["ord"] == moved["ord"], gone["old_name"] == moved["old_name"]], "left_anti").select("series", "ord", F.col("old_name").alias("field"), F.lit("removed").alias("change_kind"))
    every = same.unionByName(renamed).unionByName(added).unionByName(removed)
    f = files.select("series", "ord", "file_id")
    return every.join(f, [every["series"].eqNullSafe(f["series"]), every["ord"] == f["ord"]]).select("file_id", "field", "change_kind")


def mismatches(header: DataFrame, vlr: DataFrame, points: DataFrame) -> DataFrame:
    """(file_id, field, change_kind): files with points whose extradata hasn't the length they declare."""
    files = numbered_files(header).select("file_id")
    declared = descriptors(vlr).groupBy("file_id").agg(F.sum("size").alias("declared"))
    seen = points.where("file_id is not null").groupBy("file_id").agg(F.min(F.coalesce(F.length("extradata"), F.lit(0))).alias("low"), F.max(F.coalesce(F.length("extradata"), F.lit(0))).alias("high"))
    d = F.coalesce("declared", F.lit(0))
    return seen.join(files, "file_id").join(declared, "file_id", "left").where((F.col("low") != d) | (F.col("high") != d)).select("file_id", F.lit("extradata").alias("field"), F.lit("mismatch").alias("change_kind"))


def lifespans(header: DataFrame, vlr: DataFrame) -> DataFrame:
    """(series, field, type, first_ord, last_ord, first_file, last_file, files): each island of consecutive files."""
    files = checkpoint(numbered_files(header))
    ev = _starts_and_ends(file_fields(files, descriptors(vlr)), edges=True)
    # Starts and ends of one field and type take turns, so the next event after a start is its end.
    w = Window.partitionBy("series", "name", "type").orderBy("ord", "starts")
    runs = ev.withColumn("gone", F.lead("ord").over(w)).where("starts").select("series", F.col("name").alias("field"), "type", F.col("ord").alias("first_ord"), (F.col("gone") - 1).alias("last_ord"))
    at = lambda k: files.select(F.col("series").alias("s"), F.col("ord").alias("o"), F.col("file_id").alias(f"{k}_file"))
    for k in ("first", "last"):
        f = at(k)
        runs = runs.join(f, [runs["series"].eqNullSafe(f["s"]), runs[f"{k}_ord"] == f["o"]]).drop("s", "o")
    return runs.select("series", "field", "type", "first_ord", "last_ord", "first_file", "last_file", (F.col("last_ord") - F.col("first_ord") + 1).alias("files"))


def aliases(vlr: DataFrame) -> DataFrame:
    """(name, field, kind): the one column that each declared name is cast to.

    Names with one description are the same field, unless a file has several of them: then each name is its own.
    It takes the name that most files use (of equal ones the first) and a type that holds all: binary (the bytes of
    every file as they are) for opaque bytes, double if any file has a float, a scale or an offset, decimal for
    uint64, else long.
    """
    own = descriptors(vlr)
    rank = F.when(F.col("data_type") == 0, 3).when(F.col("data_type").isin(9, 10) | (F.col("options").bitwiseAND(SCALE | OFFSET) != 0), 2).when(F.col("data_type") == 7, 1).otherwise(0)
    d = own.groupBy("name", "description").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("rank")).withColumn("rank", F.max("rank").over(Window.partitionBy("name")))
    # A name without description, or with several, follows the description that most files give it.
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy((F.col("description") == "").cast("int"), F.desc("n"), "description"))).where("r = 1")
    key = F.when(F.col("description") == "", F.concat(F.lit("name "), F.col("name"))).otherwise(F.concat(F.lit("text "), F.col("description")))
    d = d.withColumn("key", key)
    apart = own.join(d.select("name", "key"), "name").groupBy("file_id", "key").count().where("count > 1").select("key", F.lit(True).alias("apart")).distinct()
    d = d.join(apart, "key", "left").withColumn("key", F.when(F.col("apart"), F.concat(F.lit("name "), F.col("name"))).otherwise(F.col("key")))
    to = d.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("field"), F.max("rank").alias("rank"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("long", "decimal", "double", "binary")]), F.col("to_rank") + 1)
    return d.join(to.withColumnRenamed("rank", "to_rank"), "key").select("name", "field", kinds.alias("kind"))


def _scaling(scale: str, offset: str) -> ExtraField:
    """A field with the scale and offset of a layout, where it has them."""
    real = lambda x: struct.unpack("<d", bytes.fromhex(x))[0]
    return ExtraField("", options=SCALE * bool(scale) | OFFSET * bool(offset), scale=real(scale) if scale else 1.0, offset=real(offset) if offset else 0.0)


def _binary(rows: np.ndarray, n: int, places: np.ndarray) -> pa.Array:
    """A binary array of n values with the bytes of rows at places, null elsewhere."""
    lengths = np.zeros(n + 1, np.int32)
    lengths[places + 1] = rows.shape[1]
    seen = np.zeros(n, bool)
    seen[places] = True
    bits = pa.py_buffer(np.packbits(seen, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [bits, pa.py_buffer(np.cumsum(lengths, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _decoder(columns: list[tuple[str, str]], point_columns: list[str]):
    place = {name: i for i, (name, _) in enumerate(columns)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data, lengths = flat_bytes(batch.column(batch.schema.get_field_index("_extra")))
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            layouts = batch.column(batch.schema.get_field_index("_layout")).dictionary_encode()
            codes = pa.compute.fill_null(layouts.indices, -1).to_numpy(zero_copy_only=False)
            outs = [np.zeros(n, "f8" if k == "double" else "i8") if k != "binary" else None for _, k in columns]
            opaque: dict[int, list[pa.Array]] = {}
            seen = [np.zeros(n, bool) for _ in columns]
            unsigned = {j: np.zeros(n, bool) for j, (_, k) in enumerate(columns) if k == "decimal"}
            for code, layout in enumerate(layouts.dictionary.to_pylist()):
                parts = [p.split(":") for p in layout.split(";")]
                width = sum(int(p[2]) for p in parts)
                rows = np.flatnonzero((codes == code) & (lengths == width))
                if not len(rows) or not width:
                    continue
                block = data[starts[rows][:, None] + np.arange(width)]
                at = 0
                for field, kind, size, scale, offset in parts:
                    j, size = place[field], int(size)
                    piece = np.ascontiguousarray(block[:, at : at + size])
                    at += size
                    if columns[j][1] == "binary":
                        opaque.setdefault(j, []).append(_binary(piece, n, rows))
                    elif kind != "-":
                        value = from_raw(piece.view("<" + kind).ravel(), _scaling(scale, offset))
                        outs[j][rows] = value if columns[j][1] == "double" else value.astype("i8")
                        if j in unsigned:
                            unsigned[j][rows] = kind == "u8"
                    else:
                        continue
                    seen[j][rows] = True
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in point_columns]
            for j, ((_, kind), out, ok) in enumerate(zip(columns, outs, seen)):
                if kind == "decimal":
                    # Numbers of 64 bits without sign are kept in the bits of one with sign until here.
                    whole = pa.decimal128(20, 0)
                    both = pa.compute.if_else(pa.array(unsigned[j]), pa.array(out.view("u8")).cast(whole), pa.array(out).cast(whole))
                    arrays.append(pa.compute.if_else(pa.array(ok), both, pa.scalar(None, whole)))
                elif kind == "binary":
                    arrays.append(pa.compute.coalesce(*opaque[j]) if j in opaque else pa.nulls(n, pa.binary()))
                else:
                    arrays.append(pa.array(out, {"long": pa.int64(), "double": pa.float64()}[kind], mask=~ok))
            yield pa.RecordBatch.from_arrays(arrays, [*point_columns, *[f"{name}_x" if name in point_columns else name for name, _ in columns]])

    return decode


#: Files up to which their layouts and header fields are sent to all tasks; a layout takes some hundred bytes.
LAYOUTS = 100_000
#: Points of one file that one task reads at least; further ones may go elsewhere.
FILE_BLOCK = 65_536


def first_points(points: DataFrame) -> DataFrame:
    """Repeated rows of one point_id once, that of the smallest load_id (nulls last); rows without point_id all.

    Copies share file and point_index, so one shuffle by file and block of points brings them together, and neither a
    long file nor a repeated id is a hot key.
    """
    p = points.withColumn("_block", F.floor(F.coalesce("point_index", "point_id") / FILE_BLOCK)).repartition("file_id", "_block")
    # Rows without id are groups of their own.
    p = p.withColumn("_own", F.when(F.col("point_id").isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy("file_id", "_block", "point_id", "_own").orderBy(F.col("load_id").asc_nulls_last())
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_block", "_own", "_r")


def unified_points(points: DataFrame, vlr: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """All points (repeated rows of one point_id once, each without one) in one table, a column for each field of any file.

    Of repeated rows that with the smallest load_id stays; copies share file and place (point_index). Fields that a
    file lacks are null, extra bytes become typed columns under the names of aliases(); a field
    named like a point column gets the suffix _x. Rows whose extradata hasn't the declared length keep null
    extra fields (mismatches() reports their files). Extra bytes come with scale and offset applied; whole numbers are
    kept to the last digit. scan_angle is in
    degrees: whole ones below format 6, else units of 0.006. Of a file without a usable header the format is told by
    bits2, which begins with format 6. With header the fields that its version gives a file (VERSION_FIELDS) are
    columns too.
    """
    names = aliases(vlr)
    columns = sorted((r["field"], r["kind"]) for r in names.select("field", "kind").distinct().limit(5001).collect())
    if len(columns) > 5000:
        raise ValueError("more than 5000 extra fields; no table has so many columns")
    codes = {1: "u1", 2: "i1", 3: "u2", 4: "i2", 5: "u4", 6: "i4", 7: "u8", 8: "i8", 9: "f4", 10: "f8"}
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("data_type")), F.lit("-"))
    layout = descriptors(vlr, scaling=True).join(names, "name").withColumn("p", F.struct("pos", F.concat_ws(":", "field", code, "size", "scale", "offset").alias("s")))
    layout = layout.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), ";").alias("_layout"))
    base = [c for c in points.columns if c in POINT_FIELDS or c in ("point_id", "file_id", "point_index", "load_id")]
    of_file = layout
    if header is not None:
        since = {n: m for m, names in VERSION_FIELDS.items() for n in names if n in header.columns}
        files = _first_deliveries(header, *since).select("file_id", "pdrf", *[F.when(F.col("minor") >= m, F.col(n)).alias(n) for n, m in since.items()])
        of_file, base = layout.join(files, "file_id", "full"), [*base, *since]
    # Only files that have points are met; header tables hold many more.
    of_file = checkpoint(of_file.join(points.select("file_id").distinct(), "file_id", "left_semi"))
    p = first_points(points.select(*[c for c in points.columns if c in base or c == "extradata"])).join(fitting(of_file, LAYOUTS), "file_id", "left")
    if "scan_angle" in base:
        known = [F.col("pdrf")] if header is not None else []
        p = p.withColumn("scan_angle", scan_angle_degrees("scan_angle", F.coalesce(*known, F.when(F.col("bits2").isNotNull(), 6).otherwise(0))))
    p = p.select(*base, F.col("extradata").alias("_extra"), "_layout")
    spark_kind = {"long": T.LongType(), "decimal": T.DecimalType(20, 0), "double": T.DoubleType(), "binary": T.BinaryType()}
    schema = T.StructType([p.schema[c] for c in base] + [T.StructField(f"{n}_x" if n in base else n, spark_kind[k]) for n, k in columns])
    return p.mapInArrow(_decoder(columns, base), schema)


def found(header: DataFrame, vlr: DataFrame, points: DataFrame) -> DataFrame:
    """(file_id, field, change_kind): every change of a file's fields, and files whose extra bytes mismatch."""
    return changes(header, vlr).unionByName(mismatches(header, vlr, points))


__all__ = ["aliases", "changes", "descriptors", "extra_bytes_size", "file_fields", "found", "lifespans", "mismatches", "numbered_files", "unified_points"]
