"""Variable-length records on disk."""

from __future__ import annotations

import struct

from pyspark.sql import types as T

from .header import fixed

LIMIT = 65535
SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType()), T.StructField("is_extended", T.BooleanType()), T.StructField("idx", T.IntegerType()), T.StructField("reserved", T.IntegerType()),
        T.StructField("user_id", T.StringType()), T.StructField("record_id", T.IntegerType()), T.StructField("record_length", T.LongType()), T.StructField("description", T.StringType()),
        T.StructField("data", T.BinaryType()), T.StructField("data_as_text", T.StringType()),
    ]
)


def parse(data: bytes, at: int, count: int, extended: bool) -> list[dict]:
    """Up to count records from position at; a record cut off by the end of the file ends the list."""
    out = []
    head, code = (60, "<H16sHQ32s") if extended else (54, "<H16sHH32s")
    for idx in range(count):
        if at + head > len(data):
            break
        reserved, user, record, length, text = struct.unpack_from(code, data, at)
        body = data[at + head : at + head + length]
        if len(body) < length:
            break
        cut = lambda b: b.split(b"\0", 1)[0].decode("latin-1")
        out.append({"is_extended": extended, "idx": idx, "reserved": reserved, "user_id": cut(user), "record_id": record, "record_length": length, "description": cut(text), "data": body, "data_as_text": body.decode("latin-1")})
        at += head + length
    return out


def pack(record: dict, extended: bool) -> bytes:
    data = bytes(record["data"] or b"")
    if not extended and len(data) > LIMIT:
        raise ValueError(f"record {record['record_id']} has {len(data)} bytes; more than {LIMIT} need an extended record")
    return struct.pack("<H16sH" + ("Q" if extended else "H") + "32s", record.get("reserved") or 0, fixed(record["user_id"], 16), record["record_id"], len(data), fixed(record["description"], 32)) + data


def row(record: dict, file_name: str) -> tuple:
    return (file_name, *[record[f.name] for f in SCHEMA.fields[1:]])
