"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint, in the folder the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset and all runs on this machine (tests, notebooks), a
    temporary one of this machine; on a cluster that raises."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="ckpt")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean(c: str | Column) -> Column:
    """A double column in which NaN and the infinities are null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def millimetres(c: str | Column) -> Column:
    """Whole millimetres as long; null, NaN and values beyond 9e15 mm are null."""
    v = F.round(clean(c) * 1000.0)
    return F.when(F.abs(v) <= 9.0e15, v).cast("long")


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; it stops reading soon after limit."""
    return df.limit(limit + 1).count() <= limit


def fitting(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it was counted to be small, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if small(df, limit) else df
