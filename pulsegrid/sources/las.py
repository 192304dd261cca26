"""LAS files as a Spark data source: spark.read.format("las"), df.write.format("las").

Reading options: path (a file, a folder or a pattern; for reading also a URI that pyarrow.fs knows, such as hdfs or
s3), part (points, header, vlr or check), columns (names divided by commas, only these are decoded), bbox
(x0,y0,x1,y1: of files whose header lies outside only the header is read), split_bytes, pushdown (true: comparisons on
x, y and z skip files by their header; needs spark.sql.python.filterPushdown.enabled). Records have a fixed length, so
a file is cut into ranges by its size alone; planning lists names and sizes, headers are read by the tasks. Only
finding a schema needs the headers of all files: load() does that in a Spark job, spark.read without a schema on the
driver.

Writing options: path (on a file system mounted everywhere), pdrf, minor, header (JSON of header fields), vlrs (JSON,
data in base64), layout (file: one file, its parts written by the tasks and joined in order by the driver, the default
for paths that end in .las; folder: a whole file by each task, the default for all others, which scales with the data).
Rows are written in their order within partitions, partitions in their order.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import shutil
import uuid
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import formats, header, vlr

BATCH = 65_536
SPLIT_BYTES = 64 * 2**20


def _remote(path: str):
    """The file system of a URI and the path in it; None for a path of a mounted one."""
    if "://" not in path or path.startswith("file:"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def sized_files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a path, a folder or a pattern stands for, in order of their names."""
    remote = _remote(path)
    if remote is not None:
        from pyarrow import fs

        system, inner = remote
        head = path[: len(path) - len(inner.lstrip("/"))]
        info = system.get_file_info(inner)
        found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
        out = [(head + f.path.lstrip("/"), f.size) for f in found if f.type == fs.FileType.File and (f.path == inner or f.path.lower().endswith(".las"))]
    else:
        path = local(path)
        if os.path.isdir(path):
            with os.scandir(path) as entries:
                out = [(e.path, e.stat().st_size) for e in entries if e.name.lower().endswith(".las")]
        else:
            out = [(p, os.path.getsize(p)) for p in (glob.glob(path) if glob.has_magic(path) else [path]) if os.path.exists(p)]
    if not out:
        raise FileNotFoundError(f"no LAS file at {path}")
    return sorted(out)


def files_of(path: str) -> list[str]:
    return [p for p, _ in sized_files(path)]


def opened(path: str):
    remote = _remote(path)
    return open(path, "rb") if remote is None else remote[0].open_input_file(remote[1])


def read_header(path: str) -> tuple[dict, int]:
    with opened(path) as f:
        head = f.read(header.SIZES[4])
        f.seek(0, 2)
        return header.parse(head), f.tell()


def checked(path: str) -> tuple[dict, bool]:
    """The header and whether only coordinates and intensity are read; raises where a rule rejects the file."""
    h, size = read_header(path)
    findings = header.check(h, size)
    for f in findings:
        if f.effect in ("reject", "error"):
            raise ValueError(f"{path}: {f.text} (rule {f.rule})")
        warnings.warn(f"{path}: {f.text} (rule {f.rule})", stacklevel=2)
    return h, any(f.effect == "degrade" for f in findings)


def all_checked(paths: list[str]) -> list[tuple[dict, bool]]:
    """checked() of many files at once; opening files is mostly waiting."""
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(checked, paths))


@dataclass
class Slice(InputPartition):
    """Pieces of files: (path, which of how many pieces)."""

    pieces: list[tuple[str, int, int]] = field(default_factory=list)


def slices(files: list[tuple[str, int]], split: int) -> list[Slice]:
    """Large files cut into pieces of about split bytes, small ones packed together, by size alone."""
    out, room = [], 0
    for path, size in files:
        n = max(1, -(-size // split))
        for k in range(n):
            piece = min(split, size) if n == 1 else split
            if not out or room < piece:
                out.append(Slice())
                room = split
            room -= piece
            out[-1].pieces.append((path, k, n))
    return out


def decode(raw: np.ndarray, h: dict, first: int, schema: T.StructType, path: str) -> pa.RecordBatch:
    """Records as one Arrow batch with the fields of schema; fields the file lacks are null."""
    n, arrays = len(raw), []
    for f in schema.fields:
        name = f.name
        if name == "point_index":
            arrays.append(pa.array(np.arange(first, first + n, dtype=np.int64)))
        elif name == "file_name":
            arrays.append(pa.array([path] * n, pa.string()))
        elif name not in raw.dtype.names:
            arrays.append(pa.nulls(n, _arrow(f.dataType)))
        elif name in ("x", "y", "z"):
            arrays.append(pa.array(raw[name] * h[f"scale_factor_{name}"] + h[f"{name}_offset"]))
        elif name == "extradata":
            width = raw.dtype[name].itemsize
            data = np.ascontiguousarray(raw[name]).tobytes()
            arrays.append(pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(data)]).cast(pa.binary()))
        else:
            arrays.append(pa.array(np.ascontiguousarray(raw[name])).cast(_arrow(f.dataType)))
    return pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])


def _arrow(kind: T.DataType) -> pa.DataType:
    return {
        T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(),
        T.BinaryType: pa.binary(), T.StringType: pa.string(), T.DecimalType: pa.decimal128(20, 0),
    }[type(kind)]


class PointReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.bounds: list[tuple[str, str, float]] = []
        if options.get("bbox"):
            x0, y0, x1, y1 = map(float, options["bbox"].split(","))
            self.bounds = [("x", ">=", x0), ("x", "<=", x1), ("y", ">=", y0), ("y", "<=", y1)]

    def _outside(self, h: dict) -> bool:
        return any((op == ">=" and h[f"max_{a}"] < v) or (op == "<=" and h[f"min_{a}"] > v) for a, op, v in self.bounds)

    def partitions(self) -> list[Slice]:
        return slices(sized_files(self.options["path"]), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        heads: dict[str, tuple[dict, bool]] = {}
        for path, k, n in part.pieces:
            h, degraded = heads.get(path) or heads.setdefault(path, checked(path))
            if self._outside(h):
                continue
            count, length = int(h["number_of_point_records"]), h["point_data_record_length"]
            at, end = count * k // n, count * (k + 1) // n
            dtype = formats.record_dtype(99 if degraded else h["point_data_format"], length)
            with opened(path) as f:
                f.seek(h["offset_to_point_data"] + at * length)
                while at < end:
                    rows = min(BATCH, end - at)
                    data = f.read(rows * length)
                    if len(data) < rows * length:
                        raise OSError(f"{path} ends within point {at + len(data) // length}")
                    yield decode(np.frombuffer(data, dtype), h, at, self.schema, path)
                    at += rows


class PushingReader(PointReader):
    def pushFilters(self, filters):
        """Notes lower and upper bounds of coordinates to skip files; every filter is still applied by Spark."""
        for f in filters:
            name, value = type(f).__name__, getattr(f, "value", None)
            axis = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if axis in ("x", "y", "z") and isinstance(value, (int, float)):
                if name in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                    self.bounds.append((axis, ">=", float(value)))
                if name in ("LessThan", "LessThanOrEqual", "EqualTo"):
                    self.bounds.append((axis, "<=", float(value)))
        return filters


@dataclass
class FileSlice(InputPartition):
    paths: list[str]


class MetaReader(DataSourceReader):
    """Headers, records or rule findings; files are read on the executors, some in each task."""

    def __init__(self, options: dict, part: str):
        self.options, self.part = options, part

    def partitions(self) -> list[FileSlice]:
        paths = files_of(self.options["path"])
        return [FileSlice(paths[a : a + 64]) for a in range(0, len(paths), 64)]

    def read(self, part: FileSlice) -> Iterator[tuple]:
        for path in part.paths:
            if self.part == "check":
                try:
                    findings = header.check(*read_header(path))
                except ValueError as e:
                    findings = [header.Finding(1, "error", str(e))]
                yield from ((path, f.rule, f.effect, f.text) for f in findings)
                continue
            h, size = read_header(path)
            if self.part == "header":
                yield header.row(h, path)
                continue
            with opened(path) as f:
                f.seek(h["header_size"])
                front = f.read(max(0, h["offset_to_point_data"] - h["header_size"]))
                records = vlr.parse(front, 0, h["number_of_variable_records"], False)
                start = h["start_of_extended_variable_length_record"]
                if start and h["number_of_extended_variable_length_record"] and start < size:
                    f.seek(start)
                    records += vlr.parse(f.read(), 0, h["number_of_extended_variable_length_record"], True)
            yield from (vlr.row(r, path) for r in records)


CHECK_SCHEMA = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("rule", T.IntegerType()), T.StructField("effect", T.StringType()), T.StructField("text", T.StringType())])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    stats: dict


class PointStats:
    """Count, integer bounds and points by return of encoded records."""

    def __init__(self) -> None:
        self.n, self.low, self.high, self.returns = 0, np.full(3, 2**31 - 1, np.int64), np.full(3, -(2**31), np.int64), np.zeros(16, np.int64)

    def add(self, raw: np.ndarray, pdrf: int) -> None:
        if len(raw):
            self.n += len(raw)
            for i, a in enumerate("xyz"):
                self.low[i] = min(self.low[i], raw[a].min())
                self.high[i] = max(self.high[i], raw[a].max())
            self.returns += np.bincount(raw["bits"] & (15 if pdrf >= 6 else 7), minlength=16)

    def as_dict(self) -> dict:
        return {"n": self.n, "low": self.low.tolist(), "high": self.high.tolist(), "returns": self.returns.tolist()}


def merged(stats: list[dict]) -> dict:
    live = [s for s in stats if s["n"]]
    return {
        "n": sum(s["n"] for s in live), "low": [min((s["low"][i] for s in live), default=0) for i in range(3)],
        "high": [max((s["high"][i] for s in live), default=0) for i in range(3)], "returns": [sum(s["returns"][i] for s in live) for i in range(16)],
    }


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and the length of each of its values (0 for null)."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def decimal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower 64 bits and the rest of whole decimals."""
    words = np.frombuffer(column.buffers()[1], np.uint64).reshape(-1, 2)[column.offset : column.offset + len(column)]
    return words[:, 0], words[:, 1]


def encode(batch: pa.RecordBatch, h: dict, dtype: np.dtype) -> np.ndarray:
    """Arrow rows as records. Coordinates round half away from zero; what a field can't hold is an error."""
    raw = np.zeros(batch.num_rows, dtype)
    for name in dtype.names:
        at = batch.schema.get_field_index(name)
        if at < 0:
            raise ValueError(f"point format {h['point_data_format']} needs the column {name}")
        column = batch.column(at)
        if column.null_count:
            raise ValueError(f"the column {name} has nulls, which a LAS file can't hold")
        if name == "extradata":
            width = dtype[name].itemsize
            data, lengths = flat_bytes(column)
            if (lengths != width).any():
                raise ValueError(f"extradata must have {width} bytes in every row")
            raw[name] = data.view(f"V{width}")
            continue
        if name in ("x", "y", "z"):
            v = (column.to_numpy(zero_copy_only=False).astype("f8") - h[f"{name}_offset"]) / h[f"scale_factor_{name}"]
            v = np.trunc(v + np.copysign(0.5, v))
            if not np.all(np.isfinite(v)) or (len(v) and (v.min() < -(2**31) or v.max() > 2**31 - 1)):
                raise ValueError(f"the column {name} has values that the scale and offset can't hold")
        elif pa.types.is_decimal(column.type):
            low, high = decimal_words(column)
            if (high != 0).any():
                raise ValueError(f"the column {name} has values outside 0 to {2**64 - 1}")
            v = low
        else:
            v = column.to_numpy(zero_copy_only=False)
        kind = dtype[name]
        if kind.kind in "iu" and len(v) and name not in ("x", "y", "z"):
            limits = np.iinfo(kind)
            if int(v.min()) < limits.min or int(v.max()) > limits.max:
                raise ValueError(f"the column {name} has values outside {limits.min} to {limits.max}")
        raw[name] = v
    return raw


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = local(options["path"]), overwrite
        self.folder = options.get("layout", "file" if self.path.lower().endswith(".las") else "folder") == "folder"
        names = {f.name for f in schema.fields}
        given = json.loads(options.get("header", "{}"))
        pdrf = int(options.get("pdrf", given.get("point_data_format", formats.optimal_format(names))))
        self.extra = int(options.get("extra_bytes", 0))
        self.header = header.default(pdrf, int(options["minor"]) if "minor" in options else given.get("version_minor"))
        keep = {k: v for k, v in given.items() if k in self.header and not k.startswith(("max_", "min_", "number_of", "legacy", "offset_to", "header_size", "start_of", "point_data", "version"))}
        self.header |= keep | {"point_data_record_length": formats.base_length(pdrf) + self.extra}
        records = [r | {"data": base64.b64decode(r["data"])} for r in json.loads(options.get("vlrs", "[]"))]
        self.vlrs = [vlr.pack(r, False) for r in records if not r.get("is_extended")]
        self.evlrs = [vlr.pack(r, True) for r in records if r.get("is_extended")]
        self.dtype = formats.record_dtype(pdrf, self.header["point_data_record_length"])
        missing = [n for n in self.dtype.names if n not in names]
        if missing:
            raise ValueError(f"point format {pdrf} needs the columns {', '.join(missing)}")
        if self.header["version_minor"] < 4 and self.evlrs:
            raise ValueError("extended records need version 1.4")
        self.job = uuid.uuid4().hex
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} exists; overwrite or choose another path")

    def _front(self, stats: dict) -> bytes:
        h = dict(self.header)
        size = header.size_for(h["version_minor"])
        body = b"".join(self.vlrs)
        h |= {"header_size": size, "offset_to_point_data": size + len(body), "number_of_variable_records": len(self.vlrs), "number_of_point_records": stats["n"]}
        h["number_of_points_by_return"] = stats["returns"][1:16] if h["version_minor"] >= 4 else stats["returns"][1:6]
        for i, a in enumerate("xyz"):
            s, o = h[f"scale_factor_{a}"], h[f"{a}_offset"]
            ends = [stats["low"][i] * s + o, stats["high"][i] * s + o] if stats["n"] else [0.0, 0.0]
            h[f"min_{a}"], h[f"max_{a}"] = min(ends), max(ends)
        if self.evlrs:
            h["start_of_extended_variable_length_record"] = h["offset_to_point_data"] + stats["n"] * h["point_data_record_length"]
            h["number_of_extended_variable_length_record"] = len(self.evlrs)
        return header.pack(h) + body

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        # The attempt is part of the name, so that a task run twice leaves two parts of which one is used.
        part = f"{self.path}.{self.job}.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        os.makedirs(os.path.dirname(os.path.abspath(part)), exist_ok=True)
        stats = PointStats()
        with open(part, "wb") as out:
            if self.folder:
                out.write(b"\0" * len(self._front(stats.as_dict())))
            for batch in batches:
                raw = encode(batch, self.header, self.dtype)
                stats.add(raw, self.header["point_data_format"])
                out.write(raw.tobytes())
            if self.folder:
                out.write(b"".join(self.evlrs))
                out.seek(0)
                out.write(self._front(stats.as_dict()))
        return Written(context.partitionId(), part, stats.as_dict())

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        ready = f"{self.path}.{self.job}.ready"
        if self.folder:
            os.makedirs(ready)
            for m in parts:
                if m.stats["n"]:
                    os.replace(m.path, os.path.join(ready, f"part-{m.partition:06d}.las"))
                else:
                    os.remove(m.path)
        else:
            with open(ready, "wb") as out:
                out.write(self._front(merged([m.stats for m in parts])))
                for m in parts:
                    with open(m.path, "rb") as part:
                        shutil.copyfileobj(part, out, 2**22)
                    os.remove(m.path)
                out.write(b"".join(self.evlrs))
        if os.path.isdir(self.path):
            shutil.rmtree(self.path)
        elif os.path.exists(self.path):
            os.remove(self.path)
        os.replace(ready, self.path)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        for p in glob.glob(f"{glob.escape(self.path)}.{self.job}.*"):
            os.remove(p) if os.path.isfile(p) else shutil.rmtree(p)


def schema_for(kinds: set[tuple[int, int]], many: bool, columns: str | None = None) -> T.StructType:
    """The schema of files with these formats and record lengths; many: with the column file_name."""
    wanted = [c.strip() for c in columns.split(",")] if columns else None
    fields: dict[str, T.StructField] = {}
    for pdrf, length in sorted(kinds):
        for f in formats.point_schema(pdrf, length, wanted).fields:
            fields.setdefault(f.name, f)
    order = ["point_index", *[f[0] for k in (10, 5) for f in formats.layout(k)], "extradata"]
    rows = sorted(fields.values(), key=lambda f: order.index(f.name))
    return T.StructType(([T.StructField("file_name", T.StringType())] if many else []) + rows)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The points of many files, whose schema is found by a Spark job over their headers."""
    register(spark)
    reader = spark.read.format("las").options(**options)
    c = F.col
    heads = reader.option("part", "header").load(path).select(F.when(c("point_data_format") > 10, 99).otherwise(c("point_data_format")).alias("k"), c("point_data_record_length").alias("n"))
    base = F.element_at(F.create_map(*[F.lit(x) for k in (*formats.SUPPORTED, 99) for x in (k, formats.base_length(k))]), c("k").cast("int"))
    kinds = heads.groupBy("k").agg(F.max(c("n") - base).alias("more"), F.count(F.lit(1)).alias("files")).collect()  # one row for each format
    schema = schema_for({(r["k"], formats.base_length(r["k"]) + max(r["more"], 0)) for r in kinds}, sum(r["files"] for r in kinds) > 1, options.get("columns"))
    return spark.read.format("las").options(**options).schema(schema).load(path)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        part = self.options.get("part", "points")
        if part != "points":
            return {"header": header.SCHEMA, "vlr": vlr.SCHEMA, "check": CHECK_SCHEMA}[part]
        paths = files_of(self.options["path"])
        kinds = {(99 if degraded else h["point_data_format"], h["point_data_record_length"]) for h, degraded in all_checked(paths)}
        return schema_for(kinds, len(paths) > 1, self.options.get("columns"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        part = self.options.get("part", "points")
        if part != "points":
            return MetaReader(self.options, part)
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else PointReader)(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)

    def streamReader(self, schema: T.StructType):
        from ..streaming.ingest import LasStreamReader

        return LasStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasDataSource)
