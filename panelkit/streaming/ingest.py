"""Structured Streaming forms of ingest, resampling, sessions and scoring.

Every function takes a streaming DataFrame and returns one; ``run_once`` drives
it over the files at hand (``availableNow``) into a parquet sink with its own
checkpoint, so a restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import delete_at_exit, ensure_utc, shared_dir

#: State is kept outside the heap; readings become sessions in the tasks that read them.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def stream_conf(spark: SparkSession) -> Iterator[None]:
    """``STREAM_CONF`` for the queries started inside; the session's own choices come back."""
    before = {key: spark.conf.get(key) for key in STREAM_CONF}
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _folder(spark: SparkSession, name: str) -> str:
    """A shared folder for a query's rows and checkpoint, dropped when the driver ends."""
    base = shared_dir(spark, name)
    delete_at_exit(spark, base)
    return base


def file_stream(
    spark: SparkSession, folder: str, schema, pattern: str, files_per_batch: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    r = ensure_utc(spark).readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def run_once(
    stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None
) -> DataFrame:
    """Process what is there, then return the sink's rows as a batch table."""
    spark = stream.sparkSession
    base = _folder(spark, name)
    out = out or f"{base}/rows"
    w = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or f"{base}/checkpoint")
        .trigger(availableNow=True)
    )
    with stream_conf(spark):
        w.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Drive an aggregate without watermark; the latest row of each key is returned.

    A micro-batch writes the keys that it changed, to a folder of its own number,
    so a retried batch is harmless and old state is not written again; the reader
    keeps each key's row of the highest batch.
    """
    spark = stream.sparkSession
    base = _folder(spark, name)
    rest = [c for c in stream.columns if c not in keys]

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    started = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
    )
    with stream_conf(spark):
        started.start().awaitTermination()
    every = spark.read.parquet(f"{base}/rows")
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First delivery of each (series, stamp) inside the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series_id", "ts"])


def hourly_mean(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling hourly means; readings later than the delay are dropped."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "series_id")
    return g.agg(F.avg("y").alias("y"), F.count("y").alias("n")).select(
        "series_id", F.col("window.start").alias("ts"), "y", "n"
    )


def trailing_mean(
    stream: DataFrame, width: str = "24 hours", step: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Sliding mean over a time span ending at each step.

    Readings are summed into panes of one step first; only panes, not readings, are
    copied into the windows that they belong to.  State and shuffle grow with the panes.
    """
    panes = stream.withWatermark("ts", delay).groupBy(F.window("ts", step), "series_id")
    panes = panes.agg(F.sum("y").alias("_sum"), F.count("y").alias("_n"))
    g = panes.groupBy(F.window(F.window_time("window"), width, step).alias("span"), "series_id")
    g = g.agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("n"))
    mean = F.col("_sum") / F.when(F.col("n") > 0, F.col("n"))
    return g.select("series_id", F.col("span.end").alias("ts"), mean.alias("y"), "n")


def gap_sessions(stream: DataFrame, gap: str = "48 hours", delay: str = "1 hour") -> DataFrame:
    """Segments closed by a silence longer than ``gap``.

    Session windows merge a silence of exactly ``gap``; only a reading on the watermark itself, one gap after
    the last, comes too late for that.  Under ``run_once`` every task merges its own readings into
    sessions before the shuffle: a hot series hands on its sessions, not its readings, and the
    state holds one row for each open session.
    """
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "series_id")
    g = g.agg(F.count(F.lit(1)).alias("n_obs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.drop("session_window")


def running_scores(stream: DataFrame) -> DataFrame:
    """Running error sums per (series, model); MAE, RMSE and MASE's numerator at any moment."""
    e = F.col("y_true") - F.col("y_pred")
    g = stream.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.abs(e)).alias("abs_error_sum"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
    )
    return g


def received_by_month(stream: DataFrame) -> DataFrame:
    """Readings received per series and month, for the completeness monitor."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return stream.groupBy("series_id", month).agg(F.count(F.lit(1)).alias("received"))


def completeness(received: DataFrame, expected: DataFrame) -> DataFrame:
    j = expected.join(received, ["series_id", "month"], "left").fillna(0, ["received"])
    return j.withColumn("complete", F.col("received") >= F.col("found"))


def upsert_latest(
    stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Last-wins merge: every batch is appended with its number, readers reduce.

    Appending keeps a batch cheap and idempotent (its folder is rewritten on
    retry); ``merge`` reduces the log to the latest row per key.
    """

    def save(df: DataFrame, batch: int) -> None:
        merge(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    started = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save)
    with stream_conf(stream.sparkSession):
        started.start().awaitTermination()
