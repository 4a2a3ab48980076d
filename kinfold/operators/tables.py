"""Table-level checks: profiles, repeated keys, duplicates, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """Rows, type and non-null count of every column, in one pass."""
    types = dict(df.dtypes)
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col(c).alias("non_null"))
        for c in df.columns
    ])
    return counted.select(F.col("__rows").alias("row_count"), F.explode(rows).alias("r")).select("r.*", "row_count")


def duplicate_keys(df: DataFrame, keys, weight=None) -> DataFrame:
    """Keys on more than one row."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n")).where(F.col("n") > 1)


def distinct_rows(df: DataFrame) -> DataFrame:
    """One copy of every full row."""
    return df.dropDuplicates()


def frequency(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)
