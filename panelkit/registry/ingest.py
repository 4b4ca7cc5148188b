"""Queries of the scan and sink family.

File formats are exercised by writing the driver's rows in that format to the
shared folder and scanning them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.columns import slug
from panelkit.registry.common import PREDS, READINGS, SCORED, Registry, predictions, r, scores, t, write_series_files
from panelkit.session import shared_dir
from panelkit.sources import files, panels, sinks

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def _stamp(c="ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _page(order):
    """Consecutive arrivals share a page; a page holds at most 500 readings."""
    return F.floor(F.col(order) / 500).alias("page_seq")


@reg.add("a1_sensor_csv", f"WITH {READINGS} SELECT series_id, {t('ts')}, {r('y')} FROM readings")
def a1(spark, sf):
    """One folder of files per series is written, then read as one glob."""
    base = shared_dir(spark, "sensor")
    e = panels.event_readings(spark, sf)
    out = e.select(F.col("series_id").alias("part"), _stamp().alias("timestamp"), F.col("y").alias("value"))
    out.write.partitionBy("part").option("header", True).csv(base)
    raw = files.sensor_csv(spark, f"{base}/part=*")
    # the writer names files by task; the folder carries the series here
    part = F.regexp_extract(F.input_file_name(), r"part=([^/]+)/", 1)
    return raw.withColumn("series_id", part).select("series_id", "ts", "y")


@reg.add(
    "a1_sensor_files",
    f"""SELECT event_type || '_' || strftime(ts, '%Y%m%d') AS series_id, {t("ts")}, {r("value", "y")} FROM events""",
)
def a1_files(spark, sf):
    """A file for each sensor and day; the file's name is the series."""
    base = shared_dir(spark, "sensor-files")
    series = F.concat("series_id", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("series_id")
    rows = panels.event_readings(spark, sf).select(series, _stamp().alias("timestamp"), F.col("y").alias("value"))
    write_series_files(rows, base, "parts")
    return files.sensor_csv(spark, f"{base}/files").select("series_id", "ts", "y")


@reg.add(
    "a2_station_csv",
    f"""SELECT 's' || l_suppkey AS series_id, {t("l_shipdate + to_hours(l_linenumber)", "ts")}, {r("l_quantity", "y")}, {r("l_discount", "wx_TEMP")}
    FROM lineitem""",
)
def a2(spark, sf):
    return _stations(spark, sf, "PM2.5", ["PM2.5", "TEMP"])


@reg.add(
    "a3_station_other_target",
    f"""SELECT 's' || l_suppkey AS series_id, {t("l_shipdate + to_hours(l_linenumber)", "ts")}, {r("l_discount", "y")}, {r("l_tax", "wx_PRES")}
    FROM lineitem""",
)
def a3(spark, sf):
    return _stations(spark, sf, "TEMP", ["TEMP", "PRES"])


def _stations(spark, sf, target, covariates):
    base = shared_dir(spark, "station")
    li = panels.table(spark, sf, "lineitem")
    day = F.col("l_shipdate")
    none = F.lit(None).cast("string")
    cols = {
        "No": F.col("l_orderkey"),
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "hour": F.col("l_linenumber"),
        "PM2.5": F.col("l_quantity"),
        **{k: none for k in ("PM10", "SO2", "NO2", "CO", "O3")},
        "TEMP": F.col("l_discount"),
        "PRES": F.col("l_tax"),
        "DEWP": none,
        "RAIN": none,
        "wd": none,
        "WSPM": none,
        "station": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
    }
    li.select(*[c.alias(k) for k, c in cols.items()]).write.option("header", True).option("nullValue", "NA").csv(base)
    return files.station_csv(spark, base, target, covariates)


# The event types of the table, in this order.
TYPES = ("click", "view", "purchase", "error", "signup")
WIDE_SQL = ", ".join(f"""avg(value) FILTER (event_type = '{n}') AS "{n}\"""" for n in TYPES)


@reg.add(
    "a4_wide_to_long",
    f"WITH w AS (SELECT date_trunc('hour', ts) AS ts, {WIDE_SQL} FROM events GROUP BY 1) "
    + " UNION ALL ".join(f"""SELECT {t("ts")}, '{n}' AS series_id, {r(f'"{n}"', "y")} FROM w""" for n in TYPES),
)
def a4(spark, sf):
    return files.wide_to_long(_wide(spark, sf), TYPES, "timestamp")


def _wide(spark, sf):
    e = panels.event_readings(spark, sf)
    return e.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        *[F.avg(F.when(F.col("series_id") == n, F.col("y"))).alias(n) for n in TYPES]
    )


@reg.add(
    "a5_column_coverage",
    f"WITH w AS (SELECT date_trunc('hour', ts) AS ts, {WIDE_SQL} FROM events GROUP BY 1) "
    + " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{n}' AS series_id, {r(f'avg(CASE WHEN "{n}" IS NOT NULL THEN 1.0 ELSE 0 END)', "coverage")} FROM w"""
        for i, n in enumerate(TYPES)
    ),
)
def a5(spark, sf):
    return files.column_coverage(_wide(spark, sf), TYPES)


@reg.add(
    "a5_covered_series",
    f"""SELECT 's' || l_suppkey AS series_id, {r("avg(CASE WHEN l_discount > 0.02 THEN 1.0 ELSE 0.0 END)", "coverage")} FROM lineitem
    GROUP BY l_suppkey HAVING avg(CASE WHEN l_discount > 0.02 THEN 1.0 ELSE 0.0 END) >= 0.72""",
)
def a5_long(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    long = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("series_id"),
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("y"),
    )
    return files.covered_series(long, 0.72)


@reg.add(
    "a6_covariate_csv",
    f"""SELECT {t("CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)", "ts")}, {r("avg(l_discount)", "wx_discount")}, {r("sum(l_quantity)", "wx_qty")}
    FROM lineitem GROUP BY date_trunc('day', l_shipdate)""",
)
def a6(spark, sf):
    base = shared_dir(spark, "weather")
    li = panels.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp").alias("ts"))
    w = li.agg(F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("qty"))
    w.select(_stamp().alias("timestamp"), "discount", "qty").write.option("header", True).csv(base)
    return files.weather_csv(spark, base).drop("series_id")


@reg.add(
    "a6_covariate_files",
    f"""SELECT 'l' || l_linenumber AS series_id, {t("CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)", "ts")}, {r("avg(l_discount)", "wx_discount")}, {r("sum(l_quantity)", "wx_qty")}
    FROM lineitem GROUP BY l_linenumber, date_trunc('day', l_shipdate)""",
)
def a6_files(spark, sf):
    """A covariate file for each series, named after it."""
    base = shared_dir(spark, "weather-files")
    series = F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("series_id")
    li = panels.table(spark, sf, "lineitem").groupBy(series, F.to_date("l_shipdate").cast("timestamp").alias("ts"))
    w = li.agg(F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("qty"))
    write_series_files(w.select("series_id", _stamp().alias("timestamp"), "discount", "qty"), base, "parts")
    return files.weather_csv(spark, f"{base}/files")


@reg.add(
    "a7_manifest_slug",
    """SELECT lower(replace(p_name, ' ', '_')) AS series_id, p_brand AS country, CASE WHEN p_size >= 25 THEN 'rich' ELSE 'scarce' END AS tier, p_partkey AS sensor_id FROM part""",
)
def a7(spark, sf):
    base = shared_dir(spark, "manifest")
    p = panels.table(spark, sf, "part").select(
        F.col("p_name").alias("city"),
        F.col("p_brand").alias("country"),
        F.when(F.col("p_size") >= 25, "rich").otherwise("scarce").alias("tier"),
        F.col("p_partkey").alias("sensor_id"),
        F.lit("2020-01").alias("first"),
        F.lit("2022-07").alias("last"),
        F.lit(2.5).alias("years"),
        F.lit("x").alias("station"),
    )
    p.write.option("header", True).csv(base)
    return files.manifest_csv(spark, base).select("series_id", "country", "tier", "sensor_id")


@reg.add(
    "a8_api_pages",
    f"""SELECT event_type AS series_id, {t("date_trunc('hour', ts)", "ts")}, {r("arg_max(value, event_id)", "y")} FROM events WHERE value > 2 GROUP BY event_type, date_trunc('hour', ts)""",
)
def a8(spark, sf):
    """Readings packed into page payloads, flattened, last value wins."""
    from panelkit.operators.quality import last_reading

    return last_reading(files.api_pages(_payloads(spark, sf, F.size("_r").cast("string"))), "seq")


def _payloads(spark, sf, found):
    """Readings as pages of JSON; a value of at most 2 is a null."""
    e = panels.event_readings(spark, sf)
    item = F.struct(
        F.when(F.col("y") > 2, F.col("y")).alias("value"),
        F.struct(
            F.struct(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeFrom")
        ).alias("period"),
    )
    pages = e.groupBy("series_id", _page("seq")).agg(
        F.sort_array(F.collect_list(F.struct("seq", item.alias("item")))).alias("_r")
    )
    body = F.struct(
        F.struct(found.alias("found")).alias("meta"),
        F.transform("_r", lambda x: x["item"]).alias("results"),
    )
    return pages.select("series_id", "page_seq", F.to_json(body).alias("payload"))


@reg.add(
    "a8_page_completeness",
    """WITH p AS (SELECT event_type AS series_id, CAST(floor(event_id / 500.0) AS BIGINT) AS page_seq, count(*) AS received FROM events GROUP BY ALL)
    SELECT *, CASE WHEN page_seq % 3 = 0 THEN 100 ELSE received END AS found, page_seq % 3 <> 0 OR received >= 100 AS complete FROM p""",
)
def a8_complete(spark, sf):
    """Counts as the sources write them: some say '>100', some a number, some nothing that counts."""
    kind = F.col("page_seq") % 3
    found = F.when(kind == 0, ">100").when(kind == 1, F.size("_r").cast("string")).otherwise("many")
    return files.page_completeness(_payloads(spark, sf, found))


@reg.add(
    "a9_columnar_payload",
    f"""SELECT event_type AS series_id, {t("ts")}, {r("value", "wx_value")}, {r("CAST(json_extract(props, '$.k') AS DOUBLE)", "wx_k")} FROM events""",
)
def a9(spark, sf):
    e = panels.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = F.collect_list(
        F.struct(_stamp().alias("time"), F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    ).alias("_r")
    p = e.groupBy(F.col("event_type").alias("series_id"), _page("event_id")).agg(rows)
    cols = [
        F.transform("_r", lambda x: x["time"]).alias("time"),
        F.transform("_r", lambda x: x["value"]).alias("value"),
        F.transform("_r", lambda x: x["k"]).alias("k"),
    ]
    p = p.select("series_id", F.to_json(F.struct(F.struct(*cols).alias("hourly"))).alias("payload"))
    return files.columnar_payload(p, ["value", "k"])


@reg.add(
    "a10_best_sensor",
    f"""WITH s AS (SELECT l_suppkey AS city, l_partkey AS sensor_id, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem GROUP BY ALL),
    y AS (SELECT *, ((year(l) * 12 + month(l)) - (year(f) * 12 + month(f))) / 12.0::DOUBLE AS years FROM s)
    SELECT 'c' || city AS city, sensor_id, {r("years")}, strftime(f, '%Y-%m') AS first, strftime(l, '%Y-%m') AS last FROM y WHERE years >= 1.5
    QUALIFY row_number() OVER (PARTITION BY city ORDER BY years DESC, sensor_id) = 1""",
)
def a10(spark, sf):
    """Suppliers as cities, parts as their sensors."""
    s = panels.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"),
    )
    s = s.select(
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("city"),
        F.col("l_partkey").alias("sensor_id"),
        "first",
        "last",
        F.col("l_partkey").alias("ordinal"),
    )
    return files.best_sensor(s)


@reg.add("a11_append_scores", f"WITH {SCORED} SELECT series_id, model, n_points, {r('MAE')}, {r('MASE')} FROM scores")
def a11(spark, sf):
    """Two appended runs, read back as one table."""
    out = shared_dir(spark, "scores")
    s = scores(spark, sf).select("series_id", "model", "n_points", "MAE", "MASE")
    sinks.append_scores(s.filter("model = 'last_value'"), out)
    sinks.append_scores(s.filter("model <> 'last_value'"), out)
    return spark.read.parquet(out).select(*s.columns)


@reg.add(
    "a12_prediction_sink",
    f"WITH {PREDS} SELECT series_id, model, fold, lead, pos, {r('y_true')}, {r('y_pred')} FROM preds",
)
def a12(spark, sf):
    out = shared_dir(spark, "preds")
    sinks.write_predictions(predictions(spark, sf).drop("ts"), out)
    return sinks.read_predictions(spark, out)


@reg.add(
    "a13_sweep_files",
    f"""SELECT l_linenumber, {r("l_linenumber * 0.5", "alpha")}, l_linenumber + 40 AS seed, count(*) AS n, {r("avg(l_discount)", "m")}
    FROM lineitem GROUP BY l_linenumber""",
)
def a13(spark, sf):
    """alpha and seed parsed from the names of a written sweep.

    The partition folder carries the cell label, as the file names would.
    """
    base = shared_dir(spark, "sweep")
    li = panels.table(spark, sf, "lineitem")
    name = F.concat(
        F.lit("a"), (F.col("l_linenumber") * 0.5).cast("string"), F.lit("_s"), (F.col("l_linenumber") + 40).cast("string")
    )
    li.select(name.alias("cell"), "l_linenumber", "l_discount").write.partitionBy("cell").option("header", True).csv(base)
    rows = files.sweep_files(spark, f"{base}/cell=*", "l_linenumber long, l_discount double")
    rows = rows.withColumn("seed", F.col("seed").cast("long"))
    return rows.groupBy("l_linenumber", "alpha", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m")
    )


@reg.add(
    "a14_replicate_union",
    f"""SELECT l_returnflag AS series_id, l_linenumber AS rep, count(*) AS n, {r("avg(l_tax)", "mean_tax")} FROM lineitem GROUP BY ALL""",
)
def a14(spark, sf):
    base = shared_dir(spark, "reps")
    li = panels.table(spark, sf, "lineitem")
    name = F.concat(F.lit("rep_"), "l_returnflag", F.lit("_r"), F.col("l_linenumber").cast("string"))
    li.select(name.alias("cell"), "l_tax").write.partitionBy("cell").option("header", True).csv(base)
    rows = files.replicate_files(spark, f"{base}/cell=*", "l_tax double").withColumn("rep", F.col("rep").cast("long"))
    return rows.groupBy("series_id", "rep").agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("mean_tax"))


@reg.add("a15_file_hashes")
def a15(spark, sf):
    """sha256 of every input table file."""
    return files.file_hashes(spark, sf)


@reg.add(
    "a15_content_hashes",
    "SELECT doc_id, sha256(text) AS sha256, n_chars FROM documents",
)
def a15_rows(spark, sf):
    d = panels.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars")
