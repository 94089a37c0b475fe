"""Point views over the driver's tables, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1048576
    return li.select(
        key.alias("point_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.round(F.col("l_discount") * 100).alias("z"),
        F.round(F.col("l_tax") * 100).cast("int").alias("intensity"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("classification"),
        (F.col("l_suppkey") % 16).cast("int").alias("part_index"),
    )


LI = """li AS (SELECT (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 31 + l_suppkey) % 1048576 AS point_id,
  l_quantity AS x, l_extendedprice / 1000 AS y, round(l_discount * 100) AS z,
  CAST(round(l_tax * 100) AS INTEGER) AS intensity,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS classification,
  CAST(l_suppkey % 16 AS INTEGER) AS part_index FROM lineitem)"""


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = [F.element_at("embedding", i + 1).cast("double") for i in range(6)]
    return e.select(F.col("vec_id").alias("point_id"), *(c.alias(n) for c, n in zip(at, ("x", "y", "z", "nx", "ny", "nz"))), F.col("label").alias("classification"))


EMB = """emb AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz, label AS classification FROM embeddings)"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000 / 1000000.0
    return e.select(F.col("event_id").alias("point_id"), day.alias("x"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("z"), "ts")


EV = """ev AS (SELECT event_id AS point_id, (epoch_us(ts) % 86400000000) / 1000000.0e0 AS x, value AS y, CAST(user_id AS DOUBLE) AS z, ts FROM events)"""


def sql(body: str) -> str:
    """``body`` with the views that it names in front."""
    used = [text for name, text in (("li", LI), ("emb", EMB), ("ev", EV)) if f" {name}" in body.replace("\n", " ")]
    lead = "WITH " + ",\n".join(used)
    return f"{lead}, {body[5:]}" if body.lstrip().upper().startswith("WITH ") else f"{lead}\n{body}"
