"""File scans: sensor, station, weather, wide, manifest, JSON and result files.

Schemas are explicit where the format fixes them.  Series ids, grid cells and
replicate numbers that live in file names come from ``_metadata``, so one glob
read covers all files in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.columns import nan_to_null, slug
from panelkit.session import ensure_utc

# Accepted names of the time column, in order of preference.
TIME_COLUMNS = ("timestamp", "utc_timestamp", "time", "datetime")
STATION_SCHEMA = (
    "No int, year int, month int, day int, hour int, `PM2.5` double, PM10 double, SO2 double, "
    "NO2 double, CO double, O3 double, TEMP double, PRES double, DEWP double, RAIN double, "
    "wd string, WSPM double, station string"
)
MANIFEST_SCHEMA = (
    "city string, country string, tier string, sensor_id long, first string, last string, "
    "years double, station string"
)
QUALITY_SCHEMA = (
    "city string, tier string, raw_rows long, `raw_cov_%` double, usable_hours long, "
    "usable_from string, usable_to string, PASS boolean"
)
API_PAGE = (
    "struct<meta: struct<found: string>, results: array<struct<value: double, "
    "period: struct<datetimeFrom: struct<utc: string>>>>>"
)


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.[^.]+)?$", 1)


def sniff_time_column(columns: Sequence[str]) -> str:
    return next((c for c in TIME_COLUMNS if c in columns), columns[0])


def sniff_value_column(columns: Sequence[str], wanted: str | None = None) -> str:
    t = sniff_time_column(columns)
    return wanted or next((c for c in columns if c != t), columns[1])


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only; no pass over the data."""
    return spark.read.option("header", True).option("enforceSchema", True).csv(path).columns


def _text_columns(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by header line; one pass, one row per file comes back."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("block = 0 AND trim(value) <> ''").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    groups = first.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    return {g["head"]: g["files"] for g in groups}


def _named_scans(spark: SparkSession, path: str, by_name: bool) -> list[DataFrame]:
    """Text columns under their own names; one scan per header.

    Without ``by_name`` all files must have the header of the first: Spark checks
    every file's own header line and fails on another, so no column is misread.
    """
    groups = [files for files in _headers(spark, path).values()] if by_name else [path]
    out = []
    for files in groups:
        columns = _header(spark, files if isinstance(files, str) else files[0])
        reader = spark.read.schema(_text_columns(columns)).option("header", True).option("enforceSchema", False)
        out.append(reader.csv(files))
    return out


def _number(column: str) -> Column:
    """A finite or infinite number; what is none, and NaN, is null."""
    return nan_to_null(F.expr(f"try_cast(`{column}` AS double)"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sensor_csv(spark: SparkSession, path: str, column: str | None = None, by_name: bool = False) -> DataFrame:
    """timestamp,value files; the file name is the series.

    Adds seq, the line order inside a file split, as arrival order.  ``by_name``
    reads files whose headers differ, each by its own.
    """
    ensure_utc(spark)

    def read(raw: DataFrame) -> DataFrame:
        t, v = sniff_time_column(raw.columns), sniff_value_column(raw.columns, column)
        return raw.select(
            file_stem().alias("series_id"),
            F.try_to_timestamp(F.col(f"`{t}`")).alias("ts"),
            _number(v).alias("y"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
            ).alias("seq"),
        )

    return _union([read(raw) for raw in _named_scans(spark, path, by_name)])


def station_csv(
    spark: SparkSession, path: str, target: str = "PM2.5", covariates: Sequence[str] = ()
) -> DataFrame:
    """Station files with split date parts and embedded meteorology.

    ``target`` may be any numeric column; the covariates exclude it.  NA reads
    as null.
    """
    ensure_utc(spark)
    raw = (
        spark.read.schema(STATION_SCHEMA)
        .option("header", True)
        .option("nullValue", "NA")
        .csv(path)
    )
    stamp = F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0))
    covs = [nan_to_null(F.col(f"`{c}`")).alias(f"wx_{c}") for c in covariates if c != target]
    return raw.select(
        F.col("station").alias("series_id"), stamp.alias("ts"), nan_to_null(F.col(f"`{target}`")).alias("y"), *covs
    )


def weather_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, at_most: int | None = None, by_name: bool = False
) -> DataFrame:
    """Per-series covariate files: timestamp plus numeric columns.

    ``by_name`` reads files whose headers differ; a column that a file lacks is null.
    """
    ensure_utc(spark)

    def read(raw: DataFrame) -> DataFrame:
        t = sniff_time_column(raw.columns)
        names = [c for c in columns if c in raw.columns] if columns else [c for c in raw.columns if c != t]
        names = names[:at_most] if at_most else names
        return raw.select(
            file_stem().alias("series_id"),
            F.try_to_timestamp(F.col(f"`{t}`")).alias("ts"),
            *[_number(c).alias(f"wx_{c}") for c in names],
        )

    return _union([read(raw) for raw in _named_scans(spark, path, by_name)])


def archive_csv(spark: SparkSession, path: str) -> DataFrame:
    """Forecast archives, a file for each series: a stamp, variables and their forecasts of earlier days.

    Files hold different variables and leads; a column that a file lacks is null.
    ``covariates.archive_pairs`` pairs what came with what was forecast.
    """
    ensure_utc(spark)

    def read(raw: DataFrame) -> DataFrame:
        t = sniff_time_column(raw.columns)
        numbers = [_number(c).alias(c) for c in raw.columns if c != t]
        return raw.select(file_stem().alias("series_id"), F.try_to_timestamp(F.col(f"`{t}`")).alias("ts"), *numbers)

    return _union([read(raw) for raw in _named_scans(spark, path, True)])


def wide_to_long(
    wide: DataFrame, columns: Sequence[str], time_column: str = "timestamp"
) -> DataFrame:
    """One column per series to long form."""
    return wide.unpivot([time_column], list(columns), "series_id", "y").withColumnRenamed(
        time_column, "ts"
    )


def column_coverage(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column, in one pass."""
    c = wide.agg(*[F.avg(F.col(f"`{k}`").isNotNull().cast("double")).alias(f"_c{i}") for i, k in enumerate(columns)])
    pairs = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("series_id"), F.col(f"_c{i}").alias("coverage"))
        for i, k in enumerate(columns)
    ]
    return c.select(F.inline(F.array(*pairs)))


def covered_series(long: DataFrame, at_least: float) -> DataFrame:
    """Series of a long table whose non-null share reaches the cut."""
    g = long.groupBy("series_id").agg(F.avg(F.col("y").isNotNull().cast("double")).alias("coverage"))
    return g.filter(F.col("coverage") >= at_least)


def columns_like(columns: Sequence[str], suffix: str, contains: str) -> list[str]:
    """Columns with the suffix, else those containing the fallback text."""
    return [c for c in columns if c.endswith(suffix)] or [c for c in columns if contains in c]


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)
    return m.withColumn("series_id", slug("city"))


def quality_csv(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.schema(QUALITY_SCHEMA).option("header", True).csv(path)
    return q.select(
        slug("city").alias("series_id"),
        "tier",
        "raw_rows",
        F.col("`raw_cov_%`").alias("raw_cov_pct"),
        "usable_hours",
        F.to_date(F.nullif("usable_from", F.lit("-"))).alias("usable_from"),
        F.to_date(F.nullif("usable_to", F.lit("-"))).alias("usable_to"),
        F.col("PASS").alias("passed"),
    )


def _parsed_pages(pages: DataFrame, payload: str) -> DataFrame:
    """Pages with their parsed payload, the items received and the items the source says it has."""
    p = pages.withColumn("_p", F.from_json(payload, API_PAGE))
    received = F.coalesce(F.size(F.coalesce("_p.results", F.array())), F.lit(0))
    found = F.expr("try_cast(ltrim('>', _p.meta.found) AS long)")
    return p.withColumns({"received": received.cast("long"), "found": F.coalesce(found, received.cast("long"))})


def page_completeness(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Items received and found of every page, empty and unreadable ones too, and whether all came.

    A page without a count, or with none that is a number, is complete as it is.
    """
    p = _parsed_pages(pages, payload)
    return p.select("series_id", "page_seq", "received", "found", (F.col("found") <= F.col("received")).alias("complete"))


def api_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Array-of-objects payloads to readings with their arrival order.

    ``pages`` hold series_id, page_seq and the JSON text.  Null values are
    skipped; found/received tell whether a page was complete.
    """
    p = _parsed_pages(pages, payload)
    rows = p.select(
        "series_id", "page_seq", "found", "received", F.posexplode("_p.results").alias("_i", "_r")
    )
    return rows.filter("_r.value IS NOT NULL").select(
        "series_id",
        F.try_to_timestamp(F.col("_r.period.datetimeFrom.utc")).alias("ts"),
        F.col("_r.value").alias("y"),
        F.struct("page_seq", F.col("_i").alias("item")).alias("seq"),
        (F.col("found") <= F.col("received")).alias("page_complete"),
    )


def columnar_payload(pages: DataFrame, variables: Sequence[str], payload: str = "payload") -> DataFrame:
    """Parallel-array payloads to rows, one column per variable."""
    fields = ", ".join(["time: array<string>", *[f"{v}: array<double>" for v in variables]])
    p = pages.withColumn("_h", F.from_json(payload, f"struct<hourly: struct<{fields}>>")["hourly"])
    zipped = F.arrays_zip(F.col("_h.time"), *[F.col(f"_h.{v}") for v in variables])
    r = p.select("series_id", F.explode(zipped).alias("_r"))
    return r.select(
        "series_id",
        F.try_to_timestamp(F.col("_r.time")).alias("ts"),
        *[F.col(f"_r.{v}").alias(f"wx_{v}") for v in variables],
    )


def months_between_labels(first: Column, last: Column) -> Column:
    """Whole months between two yyyy-MM... labels, in years."""

    def months(c: Column) -> Column:
        return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")

    return (months(last) - months(first)) / 12.0


def best_sensor(sensors: DataFrame, min_years: float = 1.5) -> DataFrame:
    """Longest-running sensor per city; the first listed wins a tie.

    ``sensors``: city, sensor_id, first, last, ordinal.  An aggregate, so a
    city with very many sensors is reduced before the shuffle.
    """
    years = months_between_labels(F.col("first"), F.col("last"))
    s = sensors.withColumn("years", years).filter(F.col("years") >= min_years)
    best = F.max(
        F.struct("years", (-F.col("ordinal")).alias("neg"), "sensor_id", "first", "last")
    ).alias("b")
    return s.groupBy("city").agg(best).select(
        "city",
        F.col("b.sensor_id").alias("sensor_id"),
        F.col("b.years").alias("years"),
        F.substring("b.first", 1, 7).alias("first"),
        F.substring("b.last", 1, 7).alias("last"),
    )


def _last_names() -> Column:
    """The folder and the name of a row's file."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def sweep_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files of a sweep; alpha and seed come from ...a<alpha>_s<seed>... in the file's or its folder's name."""
    stem = _last_names()
    cell = r"a([\d.]+)_s(\d+)"
    return spark.read.schema(schema).option("header", True).csv(path).select(
        "*",
        F.regexp_extract(stem, cell, 1).cast("double").alias("alpha"),
        F.regexp_extract(stem, cell, 2).cast("int").alias("seed"),
    )


def replicate_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replicate files rep_<series>_r<rep>_..., or folders of that name; all of them in one read."""
    stem = _last_names()
    return spark.read.schema(schema).option("header", True).csv(path).select(
        F.regexp_extract(stem, r"rep_(.+?)_r\d+", 1).alias("series_id"),
        F.regexp_extract(stem, r"rep_.+?_r(\d+)", 1).cast("int").alias("rep"),
        "*",
    )


def file_hashes(spark: SparkSession, path: str, piece: int = 4 << 20) -> DataFrame:
    """sha256 and size of every input file, one file per row.

    Only the listing comes from the scan, whose tasks hold one large file each;
    a task reads its files through pyarrow's file systems (local or mounted,
    hdfs, s3, gs) in pieces of ``piece`` bytes, so memory does not grow with a file
    and files above 2 GiB, which the binary source refuses, are hashed too.
    Equal names in different folders are separate rows.  Spark's scans plan no task
    for an empty file, so it has no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "file": [p.rsplit("/", 1)[-1] for p in batch["path"]],
                    "length": batch["length"],
                    "sha256": [_sha256(p, piece) for p in batch["path"]],
                }
            )

    return files.mapInPandas(hashed, "file string, length long, sha256 string")


def _sha256(uri: str, piece: int) -> str:
    """The hash of a file named as Spark names paths: with its scheme, nothing escaped."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        system, path = pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, path = pyarrow.fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    h = hashlib.sha256()
    with system.open_input_stream(path, compression=None, buffer_size=0) as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()
