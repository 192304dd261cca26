"""Queries of the operators for training data, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, millimetres, read
from . import bpe, mixing, neighbours, quantiles, sentences


P1_KEYS = ["grouping", "classification", "load_id", "point_source_id", "column_name"]


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reading and grouping: of each classification by load_id and by point_source_id.

    A point counts once, under its first load. Copies of a point share file and place, so they meet there.
    """
    c = F.col
    p = read(spark, sf_dir, "lasdata").where("point_id is not null").select("point_id", "file_id", F.floor(c("point_index") / 4096).alias("block"), "classification", "load_id", "point_source_id", "z", "intensity")
    p = p.repartition("file_id", "block").groupBy("file_id", "block", "point_id").agg(F.min("load_id").alias("load_id"), *[F.first(n).alias(n) for n in ("classification", "point_source_id", "z", "intensity")])
    null = F.lit(None).cast("int")
    cell = lambda grouping, load, source, name: F.struct(F.lit(grouping).alias("grouping"), "classification", load.alias("load_id"), source.alias("point_source_id"), F.lit(name).alias("column_name"), c(name).cast("double").alias("value"))
    cells = [cell(*g, n) for n in ("z", "intensity") for g in (("load", c("load_id"), null), ("point_source", null, c("point_source_id")))]
    return p.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _all_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by load and by point source, and those of whole classifications combined from those of loads."""
    base = checkpoint(quantiles.sketch(_readings(spark, sf_dir), P1_KEYS))
    null = F.lit(None).cast("int")
    whole = base.where("grouping = 'load'").select(F.lit("all").alias("grouping"), "classification", null.alias("load_id"), null.alias("point_source_id"), "column_name", "sketch")
    return base.unionByName(quantiles.merge(whole, P1_KEYS))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quantiles.percentiles(_all_sketches(spark, sf_dir), P1_KEYS)
    names = [f"p{100 * f:g}".replace(".", "_") for f in quantiles.FRACTIONS]
    return p.select(*P1_KEYS, "n", "min_value", "max_value", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(names)], "error_bound")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sketches know exactly: the number of readings and their ends."""
    p = quantiles.percentiles(_all_sketches(spark, sf_dir), P1_KEYS)
    return p.select(*P1_KEYS, "n", "min_value", "max_value")


P1_COUNTS_SQL = """
with p as (select point_id, min(load_id) as load_id, any_value(classification) as classification, any_value(point_source_id) as point_source_id,
                  any_value(z) as z, any_value(intensity) as intensity from lasdata where point_id is not null group by point_id),
r as (select classification, load_id, point_source_id, 'z' as column_name, z as v from p where not isnan(z)
      union all select classification, load_id, point_source_id, 'intensity', cast(intensity as double) from p where intensity is not null)
select 'all' as grouping, classification, cast(null as integer) as load_id, cast(null as integer) as point_source_id, column_name, count(*) as n, min(v) as min_value, max(v) as max_value from r group by classification, column_name
union all select 'load', classification, load_id, null, column_name, count(*), min(v), max(v) from r group by classification, load_id, column_name
union all select 'point_source', classification, null, point_source_id, column_name, count(*), min(v), max(v) from r group by classification, point_source_id, column_name
"""


def _key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "lasdata").where("classification = 8")
    return p.select(F.col("point_id").alias("id"), F.array(*[millimetres(c).cast("double") for c in "xyz"]).alias("vec"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(_key_points(spark, sf_dir), 4))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text from its ids again."""
    return bpe.decode_ids(p7_ids(spark, sf_dir))


def _calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = checkpoint(mixing.document_tokens(read(spark, sf_dir, "documents")))
    return tokens, mixing.calibrate(read(spark, sf_dir, "mix_plan"), mixing.cells_of(tokens))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(_calibrated(spark, sf_dir)[1])


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, calibrated = _calibrated(spark, sf_dir)
    return mixing.draw(tokens, calibrated)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, calibrated = _calibrated(spark, sf_dir)
    calibrated = checkpoint(calibrated)
    return mixing.report(mixing.draw(tokens, calibrated), calibrated)


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, calibrated = _calibrated(spark, sf_dir)
    calibrated = checkpoint(calibrated)
    return mixing.report_marginals(mixing.draw(tokens, calibrated), calibrated)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.found(read(spark, sf_dir, "documents"))


def p9_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.by_cue(sentences.fit(sentences.read_documents(read(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_percentiles, p1_counts, p5_found, p7_ids, p7_decoded, p8_found, p8_mix, p8_report, p8_marginals, p9_found, p9_cues)}


P5_SQL = """
with p as (select point_id as id, round(any_value(x)*1000) as x, round(any_value(y)*1000) as y, round(any_value(z)*1000) as z from lasdata
           where classification = 8 and point_id is not null and not isnan(x) and not isnan(y) and not isnan(z) group by point_id),
r as (select a.id, b.id as other, row_number() over (partition by a.id order by (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.id) as k
      from p a join p b on a.id <> b.id)
select distinct least(id, other) as id_a, greatest(id, other) as id_b from r where k <= 4
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_counts": P1_COUNTS_SQL, "p5_found": P5_SQL, "p7_decoded": "select doc_id, coalesce(text, '') as text from documents"}
