"""User-defined typed columns inside the extra bytes of point records.

A field has a name, a number type, option bits (0 no data, 1 min, 2 max, 3 scale, 4 offset) and optional values.
Encoding divides by the scale after subtracting the offset, rounds halves away from zero and clamps integers to
their range; decoding multiplies and adds where the bits are set and gives doubles then. min, max and no data are
stored in the domain of the raw numbers. Where the bit of no data is set, null is written as that value and read again
as null; whole numbers are packed without a detour through doubles. Type 0 packs opaque bytes, as many as the options say.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.formats import EXTRA_CODES, EXTRA_TYPES
from ..sources.header import fixed
from ..sources.las import decimal_words, flat_bytes

NO_DATA, MIN, MAX, SCALE, OFFSET = 1, 2, 4, 8, 16
CODES = {n: k for k, (n, _) in EXTRA_TYPES.items()} | {"single": 9, "double": 10}


def valid_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


@dataclass(frozen=True)
class ExtraField:
    name: str
    data_type: int = 10
    options: int = 0
    no_data: float = 0.0
    low: float = 0.0
    high: float = 0.0
    scale: float = 1.0
    offset: float = 0.0
    description: str = ""

    @property
    def size(self) -> int:
        return EXTRA_TYPES[self.data_type][1] if self.data_type else self.options

    @property
    def scaled(self) -> bool:
        return bool(self.options & (SCALE | OFFSET))

    def pack(self) -> bytes:
        """The 192 bytes of the descriptor."""
        code = {"u": "Q", "i": "q", "f": "d"}[EXTRA_CODES.get(self.data_type, "u1")[0]]
        slot = lambda v: struct.pack("<" + code, float(v) if code == "d" else int(v)) + b"\0" * 16
        real = lambda v: struct.pack("<d", v) + b"\0" * 16
        return (
            struct.pack("<HBB", 0, self.data_type, self.options) + fixed(self.name, 32) + b"\0" * 4 + slot(self.no_data) + slot(self.low) + slot(self.high)
            + real(self.scale if self.options & SCALE else 0.0) + real(self.offset if self.options & OFFSET else 0.0) + fixed(self.description, 32)
        )

    @classmethod
    def unpack(cls, data: bytes) -> ExtraField:
        kind, options = data[2], data[3]
        code = {"u": "Q", "i": "q", "f": "d"}[EXTRA_CODES.get(kind, "u1")[0]]
        value = lambda at, c: struct.unpack_from("<" + c, data, at)[0]
        text = lambda a, b: data[a:b].split(b"\0", 1)[0].decode("latin-1")
        use = kind != 0
        return cls(
            text(4, 36), kind, options, value(40, code), value(64, code), value(88, code),
            value(112, "d") if use and options & SCALE else 1.0, value(136, "d") if use and options & OFFSET else 0.0, text(160, 192),
        )


@dataclass
class ExtraBytes:
    """The fields of a cloud, in their order. Setters return the object, for chains of calls."""

    fields: list[ExtraField] = field(default_factory=list)

    @classmethod
    def of(cls, names: list[str]) -> ExtraBytes:
        return cls([ExtraField(valid_name(n)) for n in names])

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def _set(self, names: str | list[str], **values) -> ExtraBytes:
        wanted = {valid_name(n) for n in ([names] if isinstance(names, str) else names)}
        unknown = wanted - set(self.names)
        if unknown:
            raise KeyError(f"no extra field {sorted(unknown)}")
        self.fields = [replace(f, **values) if f.name in wanted else f for f in self.fields]
        return self

    def set_type(self, names, kind: str) -> ExtraBytes:
        return self._set(names, data_type=CODES[kind])

    def set_no_data(self, names, v: float) -> ExtraBytes:
        return self._set(names, no_data=v)

    def set_min(self, names, v: float) -> ExtraBytes:
        return self._set(names, low=v)

    def set_max(self, names, v: float) -> ExtraBytes:
        return self._set(names, high=v)

    def set_scale(self, names, v: float) -> ExtraBytes:
        return self._set(names, scale=v)

    def set_offset(self, names, v: float) -> ExtraBytes:
        return self._set(names, offset=v)

    def set_description(self, names, text: str) -> ExtraBytes:
        return self._set(names, description=text)

    def set_options(self, names, no_data: bool, low: bool, high: bool, scale: bool, offset: bool) -> ExtraBytes:
        return self._set(names, options=sum(b << i for i, b in enumerate((no_data, low, high, scale, offset))))

    def set_bit(self, names, bit: int, on: bool) -> ExtraBytes:
        for n in [names] if isinstance(names, str) else names:
            f = next(f for f in self.fields if f.name == valid_name(n))
            self._set(n, options=f.options | bit if on else f.options & ~bit)
        return self

    def pack(self) -> bytes:
        return b"".join(f.pack() for f in self.fields)

    @classmethod
    def unpack(cls, data: bytes) -> ExtraBytes:
        return cls([ExtraField.unpack(data[i : i + 192]) for i in range(0, len(data) // 192 * 192, 192)])

    @property
    def size(self) -> int:
        return sum(f.size for f in self.fields)

    def descriptors(self, spark) -> DataFrame:
        rows = [(f.name, f.description, EXTRA_TYPES.get(f.data_type, ("bytes", 0))[0], f.options, float(f.no_data), float(f.low), float(f.high), float(f.scale), float(f.offset)) for f in self.fields]
        return spark.createDataFrame(rows, "name string, description string, data_type string, options int, no_data double, min double, max double, scale double, offset double")


def to_raw(v: np.ndarray, f: ExtraField) -> np.ndarray:
    kind = np.dtype("<" + EXTRA_CODES[f.data_type])
    if v.dtype.kind in "iu" and kind.kind in "iu" and not f.scaled:
        # Whole numbers stay whole, so that 64 bits keep their last digits.
        limits = np.iinfo(kind)
        return np.clip(v, max(limits.min, np.iinfo(v.dtype).min), min(limits.max, np.iinfo(v.dtype).max)).astype(kind)
    v = v.astype("f8")
    if f.options & OFFSET:
        v = v - f.offset
    if f.options & SCALE:
        v = v / f.scale
    kind = np.dtype("<" + EXTRA_CODES[f.data_type])
    if kind.kind == "f":
        return v.astype(kind)
    limits = np.iinfo(kind)
    v = np.nan_to_num(np.trunc(v + np.copysign(0.5, v)), nan=f.no_data)
    out = np.clip(v, float(limits.min), float(limits.max))
    big = out >= float(limits.max)
    return np.where(big, limits.max, np.where(big, 0, out).astype(kind)).astype(kind)


def from_raw(raw: np.ndarray, f: ExtraField) -> np.ndarray:
    v = raw
    if f.options & SCALE:
        v = v.astype("f8") * f.scale
    if f.options & OFFSET:
        v = v.astype("f8") + f.offset
    return v


def _packed(column: pa.Array, f: ExtraField) -> np.ndarray:
    """A column as the raw values of a field; null is no data where the option is set, else 0."""
    if not f.data_type:
        data, lengths = flat_bytes(column)
        if (lengths != f.size).any():
            raise ValueError(f"{f.name} needs {f.size} bytes in every row")
        return data.view(f"V{f.size}")
    empty = f.no_data if f.options & NO_DATA else 0
    if pa.types.is_decimal(column.type):
        low, high = decimal_words(pa.compute.fill_null(column, 0))
        signed = EXTRA_CODES[f.data_type][0] == "i"
        if not f.scaled and (high == (low >> np.uint64(63)) * np.uint64(2**64 - 1) if signed else high == 0).all():
            raw = to_raw(low.view(np.int64) if signed else low, f)
        else:
            raw = to_raw(pa.compute.fill_null(column, 0).cast(pa.float64()).to_numpy(zero_copy_only=False), f)
    elif pa.types.is_integer(column.type):
        raw = to_raw(pa.compute.fill_null(column, 0).to_numpy(zero_copy_only=False), f)
    else:
        raw = to_raw(column.cast(pa.float64()).to_numpy(zero_copy_only=False), f)
    if column.null_count:
        raw = np.where(column.is_null().to_numpy(zero_copy_only=False), np.array(empty).astype(raw.dtype), raw)
    return raw


def encode(points: DataFrame, extra: ExtraBytes) -> DataFrame:
    """Appends the columns named like the fields to extradata and drops them."""
    fields, names = extra.fields, extra.names
    others = [c for c in points.columns if c not in names and c != "extradata"]
    source = points.select(*others, F.col("extradata") if "extradata" in points.columns else F.lit(None).cast("binary").alias("extradata"), *names)
    out = T.StructType([source.schema[c] for c in others] + [T.StructField("extradata", T.BinaryType())])
    record = np.dtype([(f.name, "<" + EXTRA_CODES[f.data_type]) if f.data_type else (f.name, f"V{f.size}") for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.zeros(b.num_rows, record)
            for i, f in enumerate(fields):
                raw[f.name] = _packed(b.column(len(others) + 1 + i), f)
            new = pa.Array.from_buffers(pa.binary(record.itemsize), b.num_rows, [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            old = pa.compute.fill_null(b.column(len(others)), b"")
            joined = pa.compute.binary_join_element_wise(old, new, pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], joined], [*others, "extradata"])

    return source.mapInArrow(work, out)


def _unpacked(raw: np.ndarray, f: ExtraField, kind: pa.DataType) -> pa.Array:
    """Raw values of a field as a column; no data is null where the option is set."""
    raw = np.ascontiguousarray(raw)
    if not f.data_type:
        return pa.Array.from_buffers(pa.binary(f.size), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    empty = raw == np.array(f.no_data).astype(raw.dtype) if f.options & NO_DATA else None
    return pa.array(from_raw(raw, f), mask=empty).cast(kind)


def decode(points: DataFrame, extra: ExtraBytes, keep: bool = False) -> DataFrame:
    """Adds a typed column for each field (double where scaled). Rows of another length raise.

    There must be extradata and at least one field, else ValueError.
    """
    if "extradata" not in points.columns or not extra.fields:
        raise ValueError("the cloud has no extra bytes")
    plain = {"u1": T.ShortType(), "i1": T.ShortType(), "u2": T.IntegerType(), "i2": T.ShortType(), "u4": T.LongType(), "i4": T.IntegerType(), "u8": T.DecimalType(20, 0), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
    fields = extra.fields
    others = [c for c in points.columns if c != "extradata" or keep]
    source = points.select(*others, F.col("extradata").alias("_extra"))
    kinds = [T.BinaryType() if not f.data_type else T.DoubleType() if f.scaled else plain[EXTRA_CODES[f.data_type]] for f in fields]
    out = T.StructType([points.schema[c] for c in others] + [T.StructField(f.name, k) for f, k in zip(fields, kinds)])
    arrow = {T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DecimalType: pa.decimal128(20, 0), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}
    record = np.dtype([(f.name, "<" + EXTRA_CODES[f.data_type]) if f.data_type else (f.name, f"V{f.size}") for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, lengths = flat_bytes(b.column(len(others)))
            if (lengths != record.itemsize).any():
                raise ValueError("extradata has not the length that the fields declare")
            raw = data.view(record)
            made = [_unpacked(raw[f.name], f, arrow[type(k)]) for f, k in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *made], [*others, *[f.name for f in fields]])

    return source.mapInArrow(work, out)


def field_ranges(points: DataFrame, names: list[str]) -> DataFrame:
    return points.agg(*[f(n).alias(f"{p}_{n}") for n in names for p, f in (("min", F.min), ("max", F.max))])
