"""Parquet sinks for predictions and scores, with resume and keyed replace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.joins import remaining

PREDICTIONS = "series_id string, fold int, lead int, pos long, y_true double, y_pred double, model string"


def append_scores(scores: DataFrame, path: str, partition_by: Sequence[str] = ("model",)) -> None:
    scores.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Long predictions, partitioned by model so that a reader prunes by it.

    Rewriting a run replaces only the models it holds.  Rows are spread over
    (model, hash of series), so one model's output is not one task.
    """
    salt = F.pmod(F.xxhash64("series_id"), F.lit(64))
    (
        preds.repartition(F.col("model"), salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(path)


def still_to_do(todo: DataFrame, spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Resume: the part of ``todo`` whose keys are not in the sink yet."""
    return remaining(todo, spark.read.parquet(path).select(*keys).distinct(), keys)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions present in ``df``; others stay as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
