from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from panelkit.operators import quality
from panelkit.sources import files, sinks


def test_sensor_files(spark, tmp_path):
    (tmp_path / "new_york.csv").write_text("utc_timestamp,PM2.5\n2024-01-01T00:00:00Z,5\n2024-01-01T02:00:00+02:00,6\nbad,7\n")
    (tmp_path / "lima.csv").write_text("utc_timestamp,PM2.5\n2024-01-01T00:00:00Z,x\n")
    df = files.sensor_csv(spark, str(tmp_path))
    rows = sorted((r["series_id"], str(r["ts"]), r["y"]) for r in df.filter("ts is not null").collect())
    assert rows == [
        ("lima", "2024-01-01 00:00:00", None),
        ("new_york", "2024-01-01 00:00:00", 5.0),
        ("new_york", "2024-01-01 00:00:00", 6.0),
    ]
    # the first line of the file wins
    kept = quality.first_reading(df.filter("series_id = 'new_york' and ts is not null"), "seq")
    assert [r["y"] for r in kept.collect()] == [5.0]


def test_sweep_and_replicate_names(spark, tmp_path):
    (tmp_path / "sweep_a1.54_s42_x.csv").write_text("model,MASE\nm,1.5\n")
    (tmp_path / "sweep_a0_s41_x.csv").write_text("model,MASE\nm,1.0\n")
    got = files.sweep_files(spark, str(tmp_path), "model string, MASE double").collect()
    assert sorted((r["alpha"], r["seed"], r["MASE"]) for r in got) == [(0.0, 41, 1.0), (1.54, 42, 1.5)]
    reps = tmp_path / "reps"
    reps.mkdir()
    (reps / "rep_new_york_r3_results.csv").write_text("model,j\nm,2\n")
    r = files.replicate_files(spark, str(reps), "model string, j double").collect()[0]
    assert (r["series_id"], r["rep"], r["j"]) == ("new_york", 3, 2.0)


def test_quality_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        "city,tier,raw_rows,raw_cov_%,usable_hours,usable_from,usable_to,PASS\n"
        "New York,rich,10,99.5,8,2020-01-01,2020-02-01,True\nLima,scarce,1,2.0,0,-,-,False\n"
    )
    got = {r["series_id"]: r for r in files.quality_csv(spark, str(tmp_path / "q.csv")).collect()}
    assert got["new_york"]["passed"] and str(got["new_york"]["usable_from"]) == "2020-01-01"
    assert got["lima"]["usable_from"] is None and not got["lima"]["passed"]


def test_api_page_found_may_be_open_ended(frame):
    body = '{"meta":{"found":">3"},"results":[{"value":1.0,"period":{"datetimeFrom":{"utc":"2024-01-01T00:00:00Z"}}},{"value":null,"period":{"datetimeFrom":{"utc":"2024-01-01T01:00:00Z"}}}]}'
    rows = files.api_pages(frame("series_id string, page_seq int, payload string", [("a", 0, body)])).collect()
    assert len(rows) == 1 and rows[0]["y"] == 1.0 and not rows[0]["page_complete"]


def test_best_sensor_first_of_equals(frame):
    rows = [("c", 1, "2020-01", "2021-06", 0), ("c", 2, "2020-01-15", "2022-01-02", 1), ("c", 3, "2020-01", "2022-01", 2), ("d", 4, "2020-01", "2020-05", 0)]
    got = files.best_sensor(frame("city string, sensor_id long, first string, last string, ordinal int", rows)).collect()
    assert [(r["city"], r["sensor_id"], r["years"]) for r in got] == [("c", 2, 2.0)]


def test_column_choice():
    cols = ["t", "de_load_actual_x", "fr_load", "a_load_actual"]
    assert files.columns_like(cols, "_load_actual_x", "load_actual") == ["de_load_actual_x"]
    assert files.columns_like(cols, "_none", "load_actual") == ["de_load_actual_x", "a_load_actual"]
    assert files.sniff_time_column(["v", "time"]) == "time" and files.sniff_value_column(["time", "v"]) == "v"


def test_hashes_and_resume(spark, tmp_path, frame):
    (tmp_path / "x.csv").write_text("abc")
    r = files.file_hashes(spark, str(tmp_path / "x.csv")).collect()[0]
    assert (r["file"], r["sha256"]) == ("x.csv", hashlib.sha256(b"abc").hexdigest())
    out = str(tmp_path / "out")
    schema = "series_id string, seed int, domain string, v double"
    sinks.replace_partitions(frame(schema, [("a", None, "x", 1.0), ("b", 1, "y", 2.0)]), out, "domain")
    todo = frame("series_id string, seed int", [("a", None), ("a", 1), ("b", 1)])
    left = sinks.still_to_do(todo, spark, out, ["series_id", "seed"]).collect()
    assert [(r["series_id"], r["seed"]) for r in left] == [("a", 1)]
    sinks.replace_partitions(frame(schema, [("c", 2, "x", 3.0)]), out, "domain")
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [2.0, 3.0]


def test_plans_push_down(spark):
    """Only the needed columns are read, and predicates reach the scan."""
    from panelkit.operators.quality import since
    from panelkit.sources.panels import table

    e = since(table(spark, "/root/testdata/sf0.001", "events"), "2024-01-15").groupBy("event_type").agg(F.avg("value"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "user_id" not in scan and "GreaterThanOrEqual(ts" in scan


def test_settled_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from panelkit import session

    seen = []
    monkeypatch.setattr(session, "shared_dir", lambda s, n: seen.append(n) or str(tmp_path / n))
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    out = session.settled(df, "half")
    assert seen == ["half"] and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(10)]
    assert (tmp_path / "half" / "_SUCCESS").exists()


def test_files_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,v,w\n2024-01-01 00:00:00,1,10\n")
    (tmp_path / "b.csv").write_text("w,timestamp,v\n20,2024-01-01 00:00:00,2\nNaN,2024-01-01 01:00:00,NaN\n")
    (tmp_path / "c.csv").write_text("timestamp,v\n2024-01-01 00:00:00,3\n")
    got = files.sensor_csv(spark, str(tmp_path), "v", by_name=True).collect()
    assert sorted((r["series_id"], r["y"]) for r in got if r["y"] is not None) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert [r["series_id"] for r in got if r["y"] is None] == ["b"]
    wx = files.weather_csv(spark, str(tmp_path), by_name=True).collect()
    assert sorted((r["series_id"], r["wx_v"], r["wx_w"]) for r in wx if r["wx_v"]) == [("a", 1.0, 10.0), ("b", 2.0, 20.0), ("c", 3.0, None)]


def test_another_header_is_refused_not_misread(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,v\n2024-01-01 00:00:00,1\n")
    (tmp_path / "b.csv").write_text("v,timestamp\n2,2024-01-01 00:00:00\n")
    try:
        rows = files.sensor_csv(spark, str(tmp_path), "v").collect()
    except Exception as refused:
        assert "header" in str(refused).lower()
    else:
        raise AssertionError(rows)


def test_gate_takes_nan_for_missing(frame):
    rows = [("s", datetime(2024, 1, 1 + h // 24, h % 24), float("nan") if h == 5 else float(h), h) for h in range(48)]
    df = frame("series_id string, ts timestamp, y double, seq long", rows)
    got = quality.usable_window(df, lo=None, hi=None, min_rows=24).collect()
    assert len(got) == 48 and [r["y"] for r in got if r["is_filled"]] == [5.0]


def test_hashes_are_streamed_in_pieces(spark, tmp_path):
    import hashlib

    folder = tmp_path / "in"
    folder.mkdir()
    bodies = {"empty.bin": b"", "a b%20c.bin": bytes(range(256)) * 41, "exact.bin": b"x" * 64}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    got = {r["file"]: (r["length"], r["sha256"]) for r in files.file_hashes(spark, str(folder), piece=32).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items() if b}


def test_hash_of_a_file_above_two_gigabytes(spark, tmp_path):
    import hashlib

    size = (1 << 31) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)  # sparse
    want = hashlib.sha256()
    for _ in range(32):
        want.update(bytes(1 << 26))
    want.update(bytes(5))
    (row,) = files.file_hashes(spark, str(tmp_path)).collect()
    assert (row["length"], row["sha256"]) == (size, want.hexdigest())


def test_page_completeness_counts_every_page(spark):
    item = '{"value": 3.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}}'
    pages = [
        ("s", 0, f'{{"meta": {{"found": ">3"}}, "results": [{item}, {item}]}}'),
        ("s", 1, f'{{"meta": {{"found": "2"}}, "results": [{item}, {item}]}}'),
        ("s", 2, '{"meta": {"found": "many"}, "results": []}'),
        ("s", 3, '{"meta": {"found": "1"}, "results": []}'),
        ("s", 4, "no json"),
        ("s", 5, None),
    ]
    df = spark.createDataFrame(pages, "series_id string, page_seq long, payload string")
    got = [tuple(r)[1:] for r in files.page_completeness(df).orderBy("page_seq").collect()]
    assert got == [(0, 2, 3, False), (1, 2, 2, True), (2, 0, 0, True), (3, 0, 1, False), (4, 0, 0, True), (5, 0, 0, True)]
    assert [r["page_complete"] for r in files.api_pages(df).orderBy("seq").collect()] == [False, False, True, True]


def test_names_of_files_are_cut_without_a_pattern(spark):
    """A pattern tried from every place of the path cost more than the reading of the rows."""
    rows = spark.range(1).select(F.named_struct(F.lit("file_path"), F.lit("file:///x/a1.5_s3/a9_s9.d/a2.5_s4/part-0.csv")).alias("_metadata"))
    named = rows.select(files._last_names().alias("name"))
    assert named.first()["name"] == "a2.5_s4/part-0.csv"
    assert "regexp" not in named._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in str(files._last_names())


def test_replicate_names_are_parsed_from_the_last_names_only(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as double) AS v").write.option("header", True).csv(str(tmp_path / "rep_x_r9" / "rep_a_b_r7"))
    got = files.replicate_files(spark, str(tmp_path / "rep_x_r9" / "*"), "v double")
    assert {tuple(r) for r in got.collect()} == {("a_b", 7, float(i)) for i in range(3)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
