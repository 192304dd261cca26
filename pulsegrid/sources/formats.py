"""Point record formats 0 to 10: fields, types and byte layouts, all little-endian."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

# Fixed values of the LAS format: name, code on disk, Spark type.
XYZ = [("x", "i4", T.DoubleType()), ("y", "i4", T.DoubleType()), ("z", "i4", T.DoubleType())]
INTENSITY = [("intensity", "u2", T.IntegerType())]
LEGACY = [
    ("bits", "u1", T.ShortType()), ("classification", "u1", T.ShortType()), ("scan_angle", "i1", T.ShortType()),
    ("user_data", "u1", T.ShortType()), ("point_source_id", "u2", T.IntegerType()),
]
EXTENDED = [
    ("bits", "u1", T.ShortType()), ("bits2", "u1", T.ShortType()), ("classification", "u1", T.ShortType()), ("user_data", "u1", T.ShortType()),
    ("scan_angle", "i2", T.ShortType()), ("point_source_id", "u2", T.IntegerType()), ("gps_time", "f8", T.DoubleType()),
]
TIME = [("gps_time", "f8", T.DoubleType())]
COLOUR = [("red", "u2", T.IntegerType()), ("green", "u2", T.IntegerType()), ("blue", "u2", T.IntegerType())]
NIR = [("nir", "u2", T.IntegerType())]
WAVE = [
    ("wave_packet_descriptor", "u1", T.ShortType()), ("wave_byte_offset", "u8", T.DecimalType(20, 0)), ("wave_packet_size", "u4", T.LongType()),
    ("wave_return_point", "f4", T.FloatType()), ("xt", "f4", T.FloatType()), ("yt", "f4", T.FloatType()), ("zt", "f4", T.FloatType()),
]
GROUPS = {
    0: [LEGACY], 1: [LEGACY, TIME], 2: [LEGACY, COLOUR], 3: [LEGACY, TIME, COLOUR], 4: [LEGACY, TIME, WAVE], 5: [LEGACY, TIME, COLOUR, WAVE],
    6: [EXTENDED], 7: [EXTENDED, COLOUR], 8: [EXTENDED, COLOUR, NIR], 9: [EXTENDED, WAVE], 10: [EXTENDED, COLOUR, NIR, WAVE],
}
SUPPORTED = tuple(GROUPS)
#: Extra-byte types by code: name and bytes; 0 stands for opaque bytes, whose number the options give.
EXTRA_TYPES = {1: ("uint8", 1), 2: ("int8", 1), 3: ("uint16", 2), 4: ("int16", 2), 5: ("uint32", 4), 6: ("int32", 4), 7: ("uint64", 8), 8: ("int64", 8), 9: ("float32", 4), 10: ("float64", 8)}
EXTRA_CODES = {1: "u1", 2: "i1", 3: "u2", 4: "i2", 5: "u4", 6: "i4", 7: "u8", 8: "i8", 9: "f4", 10: "f8"}
_NAMES = {"u1": "uint8", "i1": "int8", "u2": "uint16", "i2": "int16", "u4": "uint32", "i4": "int32", "u8": "uint64", "f4": "float32", "f8": "float64"}


def layout(pdrf: int) -> list[tuple[str, str, T.DataType]]:
    """Fields of a format in their order on disk; an unknown format has coordinates and intensity only."""
    return XYZ + INTENSITY + [f for g in GROUPS.get(pdrf, []) for f in g]


POINT_FIELDS = frozenset(f[0] for k in GROUPS for f in layout(k)) | {"extradata"}


def fields_of(pdrf: int) -> list[tuple[str, str]]:
    """(name, type) of a format's fields; coordinates are float64 to their reader."""
    return [(n, "float64" if n in "xyz" else _NAMES[c]) for n, c, _ in layout(pdrf)]


def base_length(pdrf: int) -> int:
    return sum(np.dtype("<" + c).itemsize for _, c, _ in layout(pdrf))


def extra_bytes_size(data_type: int, options: int) -> int:
    return options if data_type == 0 else EXTRA_TYPES.get(data_type, ("", 0))[1]


def record_dtype(pdrf: int, record_length: int) -> np.dtype:
    """A structured type of the whole record; bytes beyond the format are the field extradata."""
    names, kinds, offsets, at = [], [], [], 0
    for n, c, _ in layout(pdrf):
        names.append(n)
        kinds.append("<" + c)
        offsets.append(at)
        at += np.dtype(c).itemsize
    if pdrf in GROUPS and record_length > at:
        names.append("extradata")
        kinds.append(f"V{record_length - at}")
        offsets.append(at)
    return np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": record_length})


def point_schema(pdrf: int, record_length: int, columns: list[str] | None = None) -> T.StructType:
    fields = [T.StructField("point_index", T.LongType(), False)] + [T.StructField(n, t) for n, _, t in layout(pdrf)]
    if pdrf in GROUPS and record_length > base_length(pdrf):
        fields.append(T.StructField("extradata", T.BinaryType()))
    return T.StructType([f for f in fields if columns is None or f.name in columns or f.name == "point_index"])


def record_format_info() -> list[tuple]:
    """(pdrf, has_16bit_angle, has_bits2, has_time, has_color, has_nir, has_wavepackets, base_length, version_minor)."""
    return [(k, k >= 6, k >= 6, k >= 6 or TIME in GROUPS[k], COLOUR in GROUPS[k], NIR in GROUPS[k], WAVE in GROUPS[k], base_length(k), 3 if k <= 5 else 4) for k in SUPPORTED]


def optimal_format(columns: set[str], wide_angle: bool = False) -> int:
    """The format with the shortest record that holds every given point column; of equal ones the lowest."""
    need = {c for c in columns if c in POINT_FIELDS} - {"extradata"}
    fit = [k for k in SUPPORTED if need <= {f[0] for f in layout(k)} and (not wide_angle or k >= 6)]
    if not fit:
        raise ValueError(f"no record format holds {sorted(need)}")
    return min(fit, key=lambda k: (base_length(k), k))
