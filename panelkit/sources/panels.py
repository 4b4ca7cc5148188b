"""Panels built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.plans.ordered import with_position
from panelkit.session import ensure_utc, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: one series per event type, event id as arrival order."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("y"),
        F.col("event_id").alias("seq"),
    )


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings keyed by user: many sparse series."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("y"),
        F.col("event_id").alias("seq"),
    )


def hourly_means(readings: DataFrame) -> DataFrame:
    return readings.groupBy("series_id", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg("y").alias("y")
    )


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly shipped quantity and mean discount per supplier.

    The week is counted in whole days from a fixed Monday, so no calendar rule
    of either engine is involved.  One series per supplier: the panel widens
    with the data.
    """
    return _named(_weeks_by_key(spark, sf_dir))


def _weeks_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-02").cast("date"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.floor(day / 7).alias("_week"))
        .agg(F.sum("l_quantity").alias("y"), F.avg("l_discount").alias("wx_discount"))
    )


def _named(weeks: DataFrame) -> DataFrame:
    """Text key and stamp, built after the rows are few and in order: numbers sort and travel at less cost."""
    return weeks.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("series_id"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("_week") * 7).cast("int"))
        .cast("timestamp")
        .alias("ts"),
        *[c for c in weeks.columns if c != "l_suppkey"],
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier_weeks`` with row position and length.

    Numbering reads its input twice with different columns, so the weekly rows
    are written once instead of scanning the line items twice.
    """
    w = settled(_weeks_by_key(spark, sf_dir), "weeks").withColumn("_b", F.floor(F.col("_week") / 512))
    return _named(with_position(w, ["l_suppkey"], "_b", "_week")).drop("_b", "_week")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value per priority, with position and length."""
    d = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.to_date("o_orderdate").alias("day"),
        )
        .agg(F.sum("o_totalprice").alias("y"))
        .select("series_id", F.col("day").cast("timestamp").alias("ts"), "y")
    )
    d = settled(d, "days").withColumn("_b", F.year("ts"))
    return with_position(d, ["series_id"], "_b", "ts").drop("_b")
