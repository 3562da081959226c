"""Access to the driver's test tables and shared helpers for registered queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table as it is stored."""
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    """Round doubles to 6 decimals so results compare across engines.

    Rounds x * 1e6 to the nearest integer with ties away from zero, in double
    arithmetic, as SQL engines round doubles (Spark's ``round`` goes through a
    decimal string and costs ~10x more). From 2^52 on a double is already whole.
    """
    col = F.col(c) if isinstance(c, str) else c
    v = col.cast("double") * F.lit(1e6)
    whole = F.signum(v) * F.floor(F.abs(v) + F.lit(0.5)).cast("double")
    return F.when(F.abs(v) < F.lit(4.5e15), whole).otherwise(v) / F.lit(1e6)
