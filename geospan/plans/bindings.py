"""The shared tables as rasters, spectra, samples, networks and detections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.plans.registry import table

DEM_SQL = "(SELECT CAST(o_orderkey // 100 AS BIGINT) AS row, CAST(o_orderkey % 100 AS BIGINT) AS col, o_totalprice AS z FROM orders)"
SPECTRA_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / 1e5 AS nir, l_quantity / 50e0 AS red, l_discount AS green, l_tax AS blue,
 l_quantity / 60e0 + l_discount AS swir1, l_extendedprice / 2e5 + l_tax AS swir2 FROM lineitem)"""
KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
KEY_SQL = ", ".join(KEY)
SAMPLES_SQL = "(SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y, s_acctbal AS v FROM supplier)"
BOXES_SQL = """(SELECT event_id AS id, user_id % 50 AS image, value / 500 AS conf, CAST(event_id * 37 % 1009 AS DOUBLE) AS x1, CAST(event_id * 53 % 997 AS DOUBLE) AS y1,
 CAST(event_id * 37 % 1009 + 20 + event_id % 60 AS DOUBLE) AS x2, CAST(event_id * 53 % 997 + 20 + event_id % 45 AS DOUBLE) AS y2 FROM events)"""


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as a raster of 100 columns."""
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("row"), F.expr("o_orderkey % 100").alias("col"), F.col("o_totalprice").alias("z"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels with six bands."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(*KEY, (price / 1e5).alias("NIR"), (quantity / 50.0).alias("RED"), F.col("l_discount").alias("GREEN"), F.col("l_tax").alias("BLUE"), (quantity / 60.0 + F.col("l_discount")).alias("SWIR1"), (price / 2e5 + F.col("l_tax")).alias("SWIR2"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sample points."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), (key * 37 % 101).cast("double").alias("x"), (key * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), (F.col("user_id") % 50).alias("image"), (F.col("value") / 500).alias("conf"), (e * 37 % 1009).cast("double").alias("x1"), (e * 53 % 997).cast("double").alias("y1"), (e * 37 % 1009 + 20 + e % 60).cast("double").alias("x2"), (e * 53 % 997 + 20 + e % 45).cast("double").alias("y2"))
