"""Column expressions: fixed-point coordinates, bit fields, global encoding, casts and text payloads.

All of them stay inside the JVM. A null argument gives null; values that a target type can't hold raise an error
under ANSI mode, unless a function says that it clamps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_coordinate(raw: str | Column, scale: float | Column, offset: float | Column) -> Column:
    """raw * scale + offset, in that order, as files define it."""
    return _col(raw) * (scale if isinstance(scale, Column) else F.lit(scale)) + (offset if isinstance(offset, Column) else F.lit(offset))


def encode_coordinate(value: str | Column, scale: float | Column, offset: float | Column) -> Column:
    """The integer nearest to (value - offset) / scale, halves away from zero; beyond 32 bits it raises."""
    return F.round((_col(value) - offset) / scale).cast("int")


def quantise(value: str | Column, step: float) -> Column:
    return F.round(_col(value) / F.lit(step)) * F.lit(step)


_LIMITS = {"int8": (-128, 127, "smallint"), "uint8": (0, 255, "smallint"), "int16": (-32768, 32767, "smallint"), "uint16": (0, 65535, "int"), "int32": (-(2**31), 2**31 - 1, "int"), "uint32": (0, 2**32 - 1, "bigint")}


def saturating_cast(value: str | Column, kind: str) -> Column:
    """Rounds halves away from zero and clamps to the range of an integer type; NaN becomes 0."""
    low, high, target = _LIMITS[kind]
    v = F.round(_col(value).cast("double"))
    v = F.when(F.isnan(v), 0.0).otherwise(v)
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))).cast(target)


def updated_offset(low: str | Column, high: str | Column, rounding: float = 1.0, leftside: bool = False) -> Column:
    """An offset at the middle of the bounds (or at their low end), rounded to a multiple; 0 or less: unrounded."""
    v = _col(low) if leftside else 0.5 * (_col(high) + _col(low))
    if rounding <= 0:
        return v
    q = v / F.lit(float(rounding))
    return (F.floor(q) if leftside else F.round(q)).cast("double") * F.lit(float(rounding))


def optimal_scale(low: str | Column, high: str | Column, offset: str | Column, old: Column | None = None) -> Column:
    """The smallest scale that fits the bounds into 32 bits. Without extent the old scale (or null) remains."""
    far = F.greatest(F.abs(_col(low) - _col(offset)), F.abs(_col(high) - _col(offset)))
    return F.when(far > 0, far / F.lit(float(2**31 - 1))).otherwise(old if old is not None else F.lit(None).cast("double"))


def _bits(c: Column, at: int, width: int) -> Column:
    return F.shiftright(c.cast("int"), at).bitwiseAND(F.lit(2**width - 1))


# Name, first bit and width of each field.
LEGACY_BITS = [("return_number", 0, 3), ("number_of_returns", 3, 3), ("scan_direction", 6, 1), ("edge_of_flight_line", 7, 1)]
LEGACY_CLASS = [("class_code", 0, 5), ("synthetic", 5, 1), ("key_point", 6, 1), ("withheld", 7, 1)]
EXTENDED_BITS = [("return_number", 0, 4), ("number_of_returns", 4, 4)]
EXTENDED_BITS2 = [("synthetic", 0, 1), ("key_point", 1, 1), ("withheld", 2, 1), ("overlap", 3, 1), ("scanner_channel", 4, 2), ("scan_direction", 6, 1), ("edge_of_flight_line", 7, 1)]
ENCODING = [("gps_time_type", 0, 1), ("waveform_internal", 1, 1), ("waveform_external", 2, 1), ("synthetic_returns", 3, 1), ("wkt", 4, 1), ("reserved", 5, 11)]


def decode_fields(c: str | Column, fields: list[tuple[str, int, int]]) -> list[Column]:
    return [_bits(_col(c), at, width).alias(name) for name, at, width in fields]


def encode_fields(values: dict[str, str | Column], fields: list[tuple[str, int, int]]) -> Column:
    """Packs named fields, each masked to its width; absent ones are 0."""
    out = F.lit(0)
    for name, at, width in fields:
        if name in values:
            out = out.bitwiseOR(F.shiftleft(_col(values[name]).cast("int").bitwiseAND(F.lit(2**width - 1)), at))
    return out


def gps_time_text(encoding: str | Column) -> Column:
    return F.when(_bits(_col(encoding), 0, 1) == 1, "Adjusted Standard GPS Time").otherwise("GPS Time of Week")


def gps_timestamp(gps_time: str | Column, encoding: str | Column) -> Column:
    """The time of adjusted standard readings (1980-01-06 + 1e9 s, leap seconds not removed); null for times of week."""
    seconds = _col(gps_time) + F.lit(1e9 + 315964800.0)
    return F.when(_bits(_col(encoding), 0, 1) == 1, F.timestamp_seconds(seconds))


def scan_angle_degrees(angle: str | Column, pdrf: int | Column) -> Column:
    wide = pdrf >= 6
    small, large = _col(angle).cast("double"), _col(angle).cast("double") * F.lit(0.006)
    return F.when(wide, large).otherwise(small) if isinstance(pdrf, Column) else (large if wide else small)


def text_to_payload(text: str | Column) -> Column:
    """One byte for each character; characters beyond latin-1 raise."""
    return F.encode(_col(text), "ISO-8859-1")


def payload_to_text(data: str | Column) -> Column:
    return F.decode(_col(data), "ISO-8859-1")


def version_minor_for(pdrf: str | Column) -> Column:
    return F.when(_col(pdrf) <= 5, 3).otherwise(4)
