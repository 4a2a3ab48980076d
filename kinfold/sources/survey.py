"""Survey inputs: CSV scans with missing-value tokens, and the joined respondent table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.columns import require
from kinfold.functions.values import NA_TOKENS
from kinfold.sources.workspace import parallelism


def read_table(spark: SparkSession, path: str, columns: dict, limit: int | None = None) -> DataFrame:
    """Scan a CSV with a header row.

    `columns` maps each source column to (name, type). Every NA token becomes null
    before the cast; columns not listed are dropped. `limit` reads the first rows only. A value that its type cannot
    hold as it is - text, or a fraction for an integer - stops the scan. Quotes inside quoted fields are doubled.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    if limit is not None:
        raw = raw.limit(limit)
    require(raw, *columns)
    out = []
    for source, (name, kind) in columns.items():
        text = F.when(~F.col(f"`{source}`").isin(*NA_TOKENS), F.col(f"`{source}`"))
        value = text
        if kind in ("int", "long"):
            value = text.try_cast("double")
            value = F.when(value == F.floor(value), value)
        bad = F.raise_error(F.concat(F.lit(f"{source} cannot be read as {kind}: "), text))
        out.append(F.coalesce(value.try_cast(kind), F.when(text.isNotNull(), bad).cast(kind)).alias(name))
    return raw.select(*out)


def read_primary(spark, path, limit=None) -> DataFrame:
    return read_table(
        spark, path,
        {"villageId": ("group_id", "string"), "i": ("id", "string"), "female": ("female", "int")},
        limit,
    )


def read_secondary(spark, path, limit=None) -> DataFrame:
    return read_table(
        spark, path,
        {
            "villageId": ("group_id", "string"),
            "i": ("id", "string"),
            "villageTxt": ("group_txt", "string"),
            "hh": ("hh_id", "string"),
        },
        limit,
    )


def read_nominations(spark, path, limit=None) -> DataFrame:
    return read_table(
        spark, path,
        {
            "villageId": ("group_id", "string"),
            "i": ("i_id", "string"),
            "j": ("j_id", "string"),
            "type": ("type", "string"),
        },
        limit,
    )


def respondents(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One-to-one inner join on id; an id that repeats in a table stops it.

    The group of the primary table is kept; null ids never match. The check is an aggregate by id, which the join
    needs the rows dealt out by anyway.
    """
    require(primary, "id", "group_id", "female")
    require(secondary, "id", "group_txt", "hh_id")
    return _by_id(primary, "group_id", "female").join(_by_id(secondary, "group_txt", "hh_id"), "id", "inner")


def _by_id(table: DataFrame, *columns: str) -> DataFrame:
    rows = table.where(F.col("id").isNotNull()).groupBy("id").agg(F.first(F.struct(*columns)).alias("r"), F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col("id"))))
    return rows.select("id", once.alias("r")).select("id", *[F.col(f"r.{c}") for c in columns])


def write_draws(draws: DataFrame, path: str, buckets: int | None = None) -> None:
    """Snapshot of fitted draws: a folder for each model, in it the series in buckets, each sorted by value.

    `read_draws` keeps this distribution, so that groups and windows by series need no exchange.
    """
    spark = draws.sparkSession
    buckets = buckets or parallelism(spark)
    name = f"kinfold_draws_{uuid.uuid4().hex}"
    (
        draws.repartition(buckets, "parameter", "category")
        .write.mode("errorifexists").format("parquet").partitionBy("model").bucketBy(buckets, "parameter", "category")
        .sortBy("parameter", "category", "value").option("path", path).saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/_layout")


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot with the distribution it was written in, as a table of this session."""
    buckets = spark.read.schema("buckets int").json(f"{path}/_layout").first()["buckets"]
    columns = [f for f in spark.read.parquet(path).schema.fields if f.name != "model"]
    name = f"kinfold_draws_{uuid.uuid4().hex}"
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(
        f"CREATE TABLE {name} ({listed}, model string) USING parquet PARTITIONED BY (model) "
        f"CLUSTERED BY (parameter, category) SORTED BY (parameter, category, value) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)
