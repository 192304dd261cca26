"""The public header block: parsing, packing, defaults and consistency rules."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import types as T

from . import formats

# Name and struct code in the order on disk.
BASE = [
    ("source_id", "H"), ("global_encoding", "H"), ("project_id_guid1", "I"), ("project_id_guid2", "H"), ("project_id_guid3", "H"), ("project_id_guid4", "8s"),
    ("version_major", "B"), ("version_minor", "B"), ("system_identifier", "32s"), ("generating_software", "32s"), ("file_creation_day_of_year", "H"), ("file_creation_year", "H"),
    ("header_size", "H"), ("offset_to_point_data", "I"), ("number_of_variable_records", "I"), ("point_data_format", "B"), ("point_data_record_length", "H"),
    ("legacy_number_of_point_records", "I"), ("legacy_number_of_points_by_return", "5I"),
    ("scale_factor_x", "d"), ("scale_factor_y", "d"), ("scale_factor_z", "d"), ("x_offset", "d"), ("y_offset", "d"), ("z_offset", "d"),
    ("max_x", "d"), ("min_x", "d"), ("max_y", "d"), ("min_y", "d"), ("max_z", "d"), ("min_z", "d"),
]
FROM_3 = [("start_of_waveform_data", "Q")]
FROM_4 = [("start_of_extended_variable_length_record", "Q"), ("number_of_extended_variable_length_record", "I"), ("number_of_point_records", "Q"), ("number_of_points_by_return", "15Q")]
SIZES = {3: 235, 4: 375}
BASE_SIZE = 227
UINT32 = 2**32 - 1

_LONG, _DEC, _INT, _SHORT = T.LongType(), T.DecimalType(20, 0), T.IntegerType(), T.ShortType()
SCHEMA = T.StructType(
    [T.StructField("file_name", T.StringType())]
    + [T.StructField(n, t) for n, t in [
        ("source_id", _INT), ("global_encoding", _INT), ("project_id_guid1", _LONG), ("project_id_guid2", _INT), ("project_id_guid3", _INT), ("project_id_guid4", T.ArrayType(_SHORT)),
        ("version_major", _SHORT), ("version_minor", _SHORT), ("system_identifier", T.StringType()), ("generating_software", T.StringType()),
        ("file_creation_day_of_year", _INT), ("file_creation_year", _INT), ("header_size", _INT), ("offset_to_point_data", _LONG), ("number_of_variable_records", _LONG),
        ("point_data_format", _SHORT), ("point_data_record_length", _INT), ("number_of_point_records", _DEC), ("number_of_points_by_return", T.ArrayType(_DEC)),
        *[(n, T.DoubleType()) for n, c in BASE if c == "d"],
        ("start_of_waveform_data", _DEC), ("start_of_extended_variable_length_record", _DEC), ("number_of_extended_variable_length_record", _LONG),
        ("legacy_number_of_point_records", _LONG), ("legacy_number_of_points_by_return", T.ArrayType(_LONG)),
    ]]
)


def size_for(minor: int) -> int:
    return SIZES[min(minor, 4)] if minor >= 3 else BASE_SIZE


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def fixed(text: str | None, size: int) -> bytes:
    """A string in a field of fixed width: cut at its first NUL and at the width, padded with NUL."""
    return (text or "").encode("latin-1").split(b"\0", 1)[0][:size].ljust(size, b"\0")


def _unpack(fields: list[tuple[str, str]], data: bytes, at: int, out: dict) -> int:
    for name, code in fields:
        size = struct.calcsize("<" + code)
        got = struct.unpack_from("<" + code, data, at)
        out[name] = list(got) if len(got) > 1 else got[0]
        at += size
    return at


def parse(data: bytes) -> dict:
    """Header fields by name; fields that the version lacks are None. Raises ValueError if it is no LAS header."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file: the signature is missing")
    if len(data) < BASE_SIZE:
        raise ValueError("the file ends within its header")
    h: dict = dict.fromkeys(n for n, _ in FROM_3 + FROM_4)
    at = _unpack(BASE, data, 4, h)
    minor = h["version_minor"]
    if minor >= 3:
        data = data.ljust(SIZES[3], b"\0")
        at = _unpack(FROM_3, data, at, h)
    if minor >= 4:
        data = data.ljust(SIZES[4], b"\0")
        _unpack(FROM_4, data, at, h)
    else:
        h["number_of_point_records"] = h["legacy_number_of_point_records"]
        h["number_of_points_by_return"] = h["legacy_number_of_points_by_return"]
        h["legacy_number_of_point_records"] = h["legacy_number_of_points_by_return"] = None
    h["project_id_guid4"] = list(h["project_id_guid4"])
    for name in ("system_identifier", "generating_software"):
        h[name] = _text(h[name])
    return h


def pack(h: dict) -> bytes:
    """The bytes of a header; its size follows from the version."""
    minor, values = h["version_minor"], dict(h)
    count = int(h["number_of_point_records"] or 0)
    returns = [int(x) for x in h["number_of_points_by_return"] or []]
    small = h["point_data_format"] < 6 and count <= UINT32
    values["legacy_number_of_point_records"] = count if small or minor < 4 else 0
    values["legacy_number_of_points_by_return"] = (returns[:5] if small or minor < 4 else []) + [0] * 5
    values["number_of_points_by_return"] = (returns + [0] * 15)[:15]
    values["project_id_guid4"] = bytes((list(h.get("project_id_guid4") or []) + [0] * 8)[:8])
    out = b"LASF"
    for name, code in BASE + (FROM_3 if minor >= 3 else []) + (FROM_4 if minor >= 4 else []):
        v = values.get(name)
        if code == "32s":
            v = fixed(v, 32)
        n = int(code[:-1]) if code[:-1] and code[-1] != "s" else 0
        out += struct.pack("<" + code, *[int(x) for x in v][:n]) if n else struct.pack("<" + code, v if code[-1] in "sd" else int(v or 0))
    return out


def default(pdrf: int, minor: int | None = None) -> dict:
    h: dict = {n: 0 for n, c in BASE + FROM_3 + FROM_4}
    minor = (3 if pdrf <= 5 else 4) if minor is None else minor
    h |= {f"scale_factor_{a}": 0.001 for a in "xyz"} | {f"{a}_offset": 0.0 for a in "xyz"} | {f"{e}_{a}": 0.0 for e in ("max", "min") for a in "xyz"}
    h |= {"version_major": 1, "version_minor": minor, "system_identifier": "OTHER", "generating_software": "pulsegrid", "project_id_guid4": [0] * 8}
    h |= {"point_data_format": pdrf, "point_data_record_length": formats.base_length(pdrf), "header_size": size_for(minor), "offset_to_point_data": size_for(minor)}
    return h | {"number_of_points_by_return": [0] * (15 if minor >= 4 else 5), "legacy_number_of_points_by_return": [0] * 5}


def row(h: dict, file_name: str = "") -> tuple:
    """A row of SCHEMA."""
    from decimal import Decimal

    out = []
    for f in SCHEMA.fields:
        v = file_name if f.name == "file_name" else h.get(f.name)
        if isinstance(f.dataType, T.DecimalType):
            v = None if v is None else Decimal(v)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DecimalType):
            v = None if v is None else [Decimal(x) for x in v]
        out.append(v)
    return tuple(out)


@dataclass(frozen=True)
class Finding:
    """rule: 1 to 10 and two more, 11 and 12; effect: none, warn, degrade, reject or error."""

    rule: int
    effect: str
    text: str


def check(h: dict, file_size: int) -> list[Finding]:
    """The rules that a header breaks, in order. A rejecting rule ends the list."""
    out: list[Finding] = []

    def add(rule: int, effect: str, text: str) -> bool:
        out.append(Finding(rule, effect, text))
        return effect in ("reject", "error")

    pdrf, length, offset = h["point_data_format"], h["point_data_record_length"], h["offset_to_point_data"]
    if h["version_minor"] > 4:
        add(2, "warn", f"version 1.{h['version_minor']} is newer than 1.4")
    if offset < h["header_size"] and add(3, "reject", "the points begin within the header"):
        return out
    if pdrf > 10:
        add(4, "degrade", f"point format {pdrf} is unknown")
    if pdrf > 127 and add(5, "reject", "the points are compressed"):
        return out
    if h["version_major"] != 1 and add(6, "reject", f"version {h['version_major']} is unknown"):
        return out
    if pdrf <= 10 and length < formats.base_length(pdrf) and add(7, "reject", f"records of format {pdrf} have at least {formats.base_length(pdrf)} bytes, not {length}"):
        return out
    if pdrf > 10:
        add(8, "degrade", "only coordinates and intensity are read")
    if length < 14 and add(11, "reject", "records are shorter than coordinates and intensity"):
        return out
    if offset > file_size and add(12, "reject", "the points begin beyond the end of the file"):
        return out
    if (file_size - offset) // length < int(h["number_of_point_records"]) and add(9, "reject", "the file has fewer points than its header says"):
        return out
    if int(h["number_of_point_records"]) < 1:
        add(10, "reject", "the file has no points")
    return out
