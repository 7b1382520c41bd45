"""The `sites` fixture: point records derived from `customer` by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import usable
from tidemark.plans.registry import table


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (k * 37 % 179 - 89).cast("double").alias("latitude"),
        (k * 101 % 359 - 179).cast("double").alias("longitude"),
        (F.col("c_acctbal") / 20 - 200).alias("z_m"),
        F.col("c_nationkey").cast("int").alias("source_id"),
        F.col("c_mktsegment").alias("record_class"),
        F.when(k % 10 < 8, " Reported ").when(k % 10 == 8, "other").alias("depth_source"),
    )


def usable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(sites(spark, sf_dir))


#: WITH clauses for the oracle: s has all sites, u the usable ones with unit vectors.
SITES_SQL = """s AS (
    SELECT c_custkey AS id, CAST(c_custkey * 37 % 179 - 89 AS DOUBLE) AS latitude, CAST(c_custkey * 101 % 359 - 179 AS DOUBLE) AS longitude,
        c_acctbal / 20 - 200 AS z_m, CAST(c_nationkey AS INTEGER) AS source_id, c_mktsegment AS record_class,
        CASE WHEN c_custkey % 10 < 8 THEN ' Reported ' WHEN c_custkey % 10 = 8 THEN 'other' END AS depth_source
    FROM customer
), u AS (
    SELECT *, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z
    FROM s WHERE lower(trim(depth_source)) = 'reported' AND latitude IS NOT NULL AND longitude IS NOT NULL AND z_m <= 200
)"""
