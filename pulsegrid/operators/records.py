"""Variable-length records as a table: keyed upsert, promotion by size, presence and counts.

A record is known by user_id and record_id. It is stored once: an upsert overwrites the record where it is, keeping
its place, or appends it; a payload over 65,535 bytes goes to the extended list, any other to the plain one, and a
copy in the list not used is removed. The header's counts follow from the table when a file is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.vlr import LIMIT

WKT = ("LASF_Projection", 2112, "")
TEXT_AREA = ("LASF_Spec", 3, "Text Area Description")
EXTRA_BYTES = ("LASF_Spec", 4, "Extra Bytes Record")


def is_long(data: str | Column) -> Column:
    return F.length(F.col(data) if isinstance(data, str) else data) > LIMIT


def has_record(records: DataFrame, record_id: int, user_id: str | None = None) -> bool:
    key = F.col("record_id") == record_id
    return not records.where(key if user_id is None else key & (F.col("user_id") == user_id)).isEmpty()


def upsert(records: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records with those of new put in. new: user_id, record_id, description, data and the columns of by.

    by names further key columns, such as file_id, so that many files are served by one join. Records that are
    equal in all keys within new must not occur; rows of records with null keys are left as they are.
    """
    by = by or []
    keys = [*by, "user_id", "record_id"]
    target = new.select(*keys, "description", "data").withColumn("is_extended", is_long("data"))
    kept = records.join(target.select(*keys), keys, "left_anti")
    places = records.groupBy(*keys).agg(F.min(F.struct(F.col("is_extended"), F.col("idx"))).alias("plain"), F.max(F.struct(F.col("is_extended"), (-F.col("idx")).alias("back"))).alias("long"))
    last = records.groupBy(*by, "is_extended").agg(F.max("idx").alias("last"))
    t = target.join(places, keys, "left").join(last, [*by, "is_extended"], "left")
    old = F.when(F.col("is_extended") & F.col("long.is_extended"), -F.col("long.back")).when(~F.col("is_extended") & ~F.col("plain.is_extended"), F.col("plain.idx"))
    t = t.withColumn("idx", F.coalesce(old, F.col("last") + 1, F.lit(0)))
    ready = t.select(*by, "is_extended", "idx", F.lit(0).alias("reserved"), "user_id", "record_id", F.length("data").cast("long").alias("record_length"), "description", "data", F.decode("data", "ISO-8859-1").alias("data_as_text"))
    return kept.select(*ready.columns).unionByName(ready)


def upsert_text(records: DataFrame, text: str, kind: tuple[str, int, str] = WKT) -> DataFrame:
    """Puts one text (a coordinate system, an area description) into the records of one file."""
    spark = records.sparkSession
    row = spark.createDataFrame([(kind[0], kind[1], kind[2], bytearray(text.encode("latin-1")))], "user_id string, record_id int, description string, data binary")
    return upsert(records, row)


def with_wkt_flag(encoding: str | Column) -> Column:
    return (F.col(encoding) if isinstance(encoding, str) else encoding).bitwiseOR(F.lit(16))
