"""Listing-like views of the given tables, for the registered queries, with the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, key: str, a_core: int = 4) -> DataFrame:
    """df by a hash of key over all cores, for work that costs much more a row than reading it: a small file is one task, whatever is made of its rows."""
    return df.repartition(a_core * df.sparkSession.sparkContext.defaultParallelism, key)


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as listings: price, ward (nation), district (region), kind, date seen; area, rooms by the customer's key."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), (20 + F.col("o_custkey") % 180).cast("double").alias("area"),
        F.when(F.col("o_orderkey") % 7 != 0, (1 + F.col("o_orderkey") % 5).cast("int")).alias("rooms"), F.col("n_name").alias("ward"), F.col("r_name").alias("district"),
        F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("seen"), F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("owner"),
    )


LISTING = """
listing AS (SELECT o_orderkey AS row_id, o_totalprice AS price, (20 + o_custkey % 180)::DOUBLE AS area, CASE WHEN o_orderkey % 7 <> 0 THEN (1 + o_orderkey % 5)::INT END AS rooms,
  n_name AS ward, r_name AS district, o_orderpriority AS kind, o_orderdate AS seen, c_mktsegment AS segment, o_custkey AS owner
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as places: two components are the coordinates, the label is the ward; every ninth has none."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    at = lambda i, low, wide: (F.lit(low) + wide * (F.col("embedding")[i].cast("double") + 0.5)).alias("lat" if i == 0 else "lon")
    out = e.select(F.col("vec_id").alias("row_id"), at(0, 20.53, 0.86), at(1, 105.28, 0.75), F.col("label").alias("ward"), (F.col("vec_id") % 3).alias("district"), (1e6 * (1 + F.col("vec_id") % 97)).alias("price"))
    return out


PLACES = """
places AS (SELECT vec_id AS row_id, 20.53::DOUBLE + 0.86::DOUBLE * (embedding[1]::DOUBLE + 0.5::DOUBLE) AS lat, 105.28::DOUBLE + 0.75::DOUBLE * (embedding[2]::DOUBLE + 0.5::DOUBLE) AS lon,
  label AS ward, vec_id % 3 AS district, 1e6 * (1 + vec_id % 97) AS price FROM embeddings WHERE embedding IS NOT NULL)"""

#: DuckDB: kilometres between two places, null where a coordinate is (least() passes over nulls).
KM = "(CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"


def km_sql(a: str, b: str, c: str, d: str) -> str:
    return KM.format(a=a, b=b, c=c, d=d)
