"""Domain relations derived from the test tables by expressions that Spark and DuckDB share.

``turns`` (meeting_id, speaker, start_ms, end_ms, turn_id) come from ``events``, a day being one meeting;
``lines`` (meeting_id, speaker, start_ms, end_ms, line_id, text) from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNS_SQL = """turns AS (
  SELECT event_id AS turn_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, 'S' || (1 + user_id % 8) AS speaker,
         (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 6000 AS start_ms,
         (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 6000 + CAST(round(value * 100) AS BIGINT) * 10 AS end_ms
  FROM events)"""

LINES_SQL = """lines AS (
  SELECT conv_id AS meeting_id, role AS speaker, turn AS line_id, text,
         CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 66 AS BIGINT) AS start_ms,
         CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) * 66 AS BIGINT) AS end_ms
  FROM conversations)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(date_trunc('DAY', ts) as timestamp))) div 6000")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("turn_id"),
        F.expr("cast(cast(ts as date) as string)").alias("meeting_id"),
        F.concat(F.lit("S"), (1 + F.col("user_id") % 8).cast("string")).alias("speaker"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * 100).cast("long") * 10).alias("end_ms"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"),
        F.col("role").alias("speaker"),
        F.col("turn").alias("line_id"),
        "text",
        (F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 66).alias("start_ms"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) * 66).alias("end_ms"),
    )
