"""Current rows of tables that arrive with repeats: append-ignore and latest-row reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.sources.tables import table


def source_key(column: str = "source_id") -> Column:
    """A source's registered id: trimmed, lower case."""
    return F.lower(F.trim(F.col(column)))


def first_arrivals(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per key, the one that arrived first (append-ignore by primary key).

    Rows without a key can't be told apart from others and are left out.
    """
    seen = F.row_number().over(Window.partitionBy(key).orderBy(F.col(arrived).asc_nulls_first()))
    return df.filter(F.col(key).isNotNull()).withColumn("_seen", seen).filter("_seen = 1").drop("_seen")


def latest_rows(df: DataFrame, key: str, updated: str) -> DataFrame:
    """One row per key, the one updated last (a snapshot of an upserted table)."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(F.col(updated).desc_nulls_last()))
    return df.filter(F.col(key).isNotNull()).withColumn("_seen", seen).filter("_seen = 1").drop("_seen")


def items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The items, each id once, with the source id in registered form."""
    wanted = dict.fromkeys(("id", "fetched_ts", "source_id", *columns))
    df = table(spark, folder, "items").select(*wanted)
    return first_arrivals(df, "id", "fetched_ts").withColumn("source_id", source_key())


def clusters(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The clusters as last updated."""
    wanted = dict.fromkeys(("id", "updated_ts", *columns))
    return latest_rows(table(spark, folder, "clusters").select(*wanted), "id", "updated_ts")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources")


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """The fetch log without exact repeats."""
    return table(spark, folder, "source_probes").dropDuplicates()


#: The same reads in SQL, to open a WITH list.
IT_SQL = """it AS (SELECT * EXCLUDE (_n, source_id), lower(trim(source_id)) AS source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_ts NULLS FIRST) AS _n FROM items WHERE id IS NOT NULL) WHERE _n = 1)"""
CL_SQL = """cl AS (SELECT * EXCLUDE (_n) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_ts DESC NULLS LAST) AS _n FROM clusters WHERE id IS NOT NULL) WHERE _n = 1)"""
PR_SQL = "pr AS (SELECT DISTINCT * FROM source_probes)"
