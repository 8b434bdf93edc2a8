"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import snapshot as materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts_for(spark: SparkSession) -> int:
    """Salts per hot key: follows the shuffle partitions, which follow the data."""
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def rank_within(
    df: DataFrame, keys: Sequence[str], salt_of: Column, order: Sequence[Column], out: str, salts: int | None = None
) -> DataFrame:
    """Number the rows of each key 0, 1, ... without gathering a key in one task.

    A key's rows are dealt to salts by a hash of ``salt_of``; the counts per (key, salt) give
    each salt its first number, and a window numbers the rows of one salt. Equal inputs get
    equal numbers as long as ``order`` decides between unequal rows. Keys must not be null.
    ``df`` is read twice: pass a materialized one.
    """
    salts = salts or salts_for(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of, F.lit(17)), F.lit(salts)).cast("int"))
    group = [*keys, "_salt"]
    counts = salted.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(inside))
        .join(starts, group)
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .drop("_salt", "_start", "_rn")
    )
